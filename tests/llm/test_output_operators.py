import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from premia.llm import infill, merkle, tokenfiles
from premia.llm.common import settings
from premia.llm.queries import word_file
from premia.session import scratch_path

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle ---------------------------------------------------------------


def brute_infill(doc_id, text, rate=50, spm=80):
    text = text or ""
    units, h = UNIT.findall(text), sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, share", [(50, 80), (100, 40)])
def test_infill_is_brute_force(spark, documents, rate, share):
    more = [(200 + k, t, "en", "s", 1, 1, 2, "3", "4", 5, 6, "7", 8.0, 9) for k, t in enumerate(
        ["a <P> b", "x<S>", "<M>", " lead", "trail \n", "$1 \\2 {3}+ (", "\U0001f600 é   <P", "< P>" * 9, "<", " ", "a\x00b c"] * 6
    )]
    table = documents.union(spark.createDataFrame(more, documents.schema)).withColumn("form", F.lit("clash"))
    found = infill.fill_in_middle(table, rate=rate, spm_share=share).withColumn("back", infill.restored())
    assert set(found.columns) == {*table.columns, "n", "prefix_chars", "middle_chars", "output", "back"}
    rows = found.collect()
    assert len(rows) == table.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_infill(r.doc_id, r.text, rate, share)
        assert r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_infill_takes_long_texts_and_other_marks(spark):
    long = "word  " * 300_000 + "\t" * 300_000 + "end" + " " * 200_000
    table = spark.createDataFrame([(k, long) for k in range(8)] + [(9, "y" * 2_000_000)], "i long, t string")
    marks = ("<|$pre|>", "<|\\suf|>", "<|mid|>")
    made = infill.fill_in_middle(table, rate=100, marks=marks, text="t", key="i")
    back = made.withColumn("back", infill.restored(marks=marks))
    assert back.where("back = t").count() == 9
    assert [r.n for r in made.orderBy("i").select("n").collect()] == [300_002] * 8 + [1]
    with pytest.raises(ValueError):
        infill.fill_in_middle(table, marks=("ab", "ba", "c"), text="t", key="i")


def test_infill_of_nothing(spark, no_documents):
    assert infill.fill_in_middle(no_documents).count() == 0


# --- Merkle manifest ------------------------------------------------------------------


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return levels


def brute_proof(levels, at):
    return [(lvl[at >> k ^ 1] if at >> k ^ 1 < len(lvl) else None) for k, lvl in enumerate(levels[:-1])]


def test_addresses_are_a_van_emde_boas_order():
    for levels in range(1, 10):
        places = [merkle.address(levels, d, k) for d in range(levels) for k in range(1 << d)]
        assert sorted(places) == list(range((1 << levels) - 1))
    # Four levels: the upper two, then the four lower subtrees one after another.
    assert [merkle.address(4, 2, k) for k in range(4)] == [3, 6, 9, 12]
    assert merkle.address(4, 3, np.arange(8)).tolist() == [4, 5, 7, 8, 10, 11, 13, 14]


@pytest.mark.parametrize("height", [1, 2, 3, 8])
def test_manifest_is_brute_force(spark, height):
    settings(spark)
    groups = {None: 1, "": 5, "a": 67, "b": 16, "é": 2, "z": 33}
    rows = [(g, k * 7 % n, sha(f"{g}{k}"), "x", 1.0) for g, n in groups.items() for k in range(n)]
    rows += [rows[10]] * 3 + [("a", None, sha("none"), "x", 2.0), ("b", 3, sha("same id"), None, None)]
    table = spark.createDataFrame(rows, "lang string, doc_id long, leaf string, part string, n double").repartition(5)
    manifest = merkle.build_manifest(table, keep=["part", "n"], height=height)
    with pytest.raises(ValueError):
        merkle.build_manifest(table, key="leaf")
    found = manifest.proofs().withColumn("folded", merkle.folded(F.col("leaf"), F.col("siblings"), F.col("path")))
    assert found.columns == ["doc_id", "part", "n", "leaf", "subroot", "root", "siblings", "path", "folded"]
    got = sorted(str((r[0], *r[3:])) for r in found.collect())

    of = {}
    for g, k, leaf, *_ in rows:
        of.setdefault(g, []).append((-1 if k is None else k, leaf, k))
    order = sorted(of, key=lambda g: b"" if g is None else b"=" + g.encode())
    trees = {g: brute_tree([leaf for _, leaf, _ in sorted(of[g])]) for g in order}
    top = brute_tree([trees[g][-1][0] for g in order])
    expected = []
    for place, g in enumerate(order):
        for at, (_, leaf, k) in enumerate(sorted(of[g])):
            proof = brute_proof(trees[g], at) + brute_proof(top, place)
            path = at | place << (len(trees[g]) - 1)
            root = top[-1][0]
            expected.append(str((k, leaf, trees[g][-1][0], root, proof, path, root)))
    assert got == sorted(expected)
    # What the blocks hold is bounded, and every stage is smaller by 2^height.
    assert all(b.selectExpr("max(size(members))").first()[0] <= 1 << height for b in manifest.blocks)
    wrong = found.select(merkle.folded(F.sha2("leaf", 256), F.col("siblings"), F.col("path")).alias("f"), "root")
    assert wrong.where("f = root").isEmpty()


def test_record_digest_tells_nulls_from_texts(spark):
    table = spark.createDataFrame([(1, None, "é"), (2, "-", ""), (None, "", None)], "a long, b string, c string")
    found = [r[0] for r in table.select(merkle.record_digest([F.col(c) for c in "abc"])).collect()]
    assert found == [sha("1:1-2:é"), sha("1:21:-0:"), sha("-0:-")]


def test_manifest_of_nothing(spark):
    table = spark.createDataFrame([], "lang string, doc_id long, leaf string")
    assert merkle.build_manifest(table).proofs().count() == 0


# --- token files ----------------------------------------------------------------------


def test_token_files_are_the_library(spark, documents, monkeypatch):
    settings(spark)
    monkeypatch.setattr(tokenfiles, "PIECE", 2000)
    monkeypatch.setattr(tokenfiles, "TOGETHER", 5000)
    library = Tokenizer.from_file(word_file())
    folder = scratch_path(spark, "files")
    shards = tokenfiles.write_tokens(documents, word_file(), folder, shard_bytes=50_000).orderBy("shard").collect()
    assert len(shards) > 3
    assert [s.base for s in shards] == [sum(x.n_tokens for x in shards[:k]) for k in range(len(shards))]
    rows = sorted(tokenfiles.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    expected = sorted(
        (-1 if r.doc_id is None else r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
        for r in documents.collect()
    )
    keys = [-1 if r.key is None else r.key for r in rows]
    assert keys == sorted(keys)
    assert sorted((k, bytes(r.ids)) for k, r in zip(keys, rows, strict=True)) == expected
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)
    # The files themselves: flat integers, nothing before or between them.
    whole = b"".join(np.memmap(f"{folder}/{s.stem}.ids", f"<u{s.width}", "r").astype("<u4").tobytes() for s in shards)
    assert whole == b"".join(bytes(r.ids) for r in rows)


def test_pieces_of_a_text_have_its_ids():
    library = Tokenizer.from_file(word_file())
    text = "It's 3 o'clock, don't  wait. İstanbul ÉCOLE été naïve \U0001f600 x́ y's  <|endoftext|> end " * 40
    whole, before = library.encode(text, add_special_tokens=False).ids, tokenfiles.PIECE
    try:
        for tokenfiles.PIECE in (1, 7, 100):
            parts = tokenfiles.pieces(text)
            assert "".join(parts) == text and len(parts) > 3
            assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == whole
    finally:
        tokenfiles.PIECE = before


def test_token_files_of_nothing_and_a_wide_vocabulary(spark, no_documents):
    folder = scratch_path(spark, "files")
    assert tokenfiles.write_tokens(no_documents, word_file(), folder).count() == 0
    assert tokenfiles.read_tokens(spark, folder).count() == 0
    wide = scratch_path(spark, "files")
    one = spark.createDataFrame([(5, "a b", 1), (4, None, 2)], "id long, body string, ids int")
    made = tokenfiles.write_tokens(one, word_file(), wide, end_id=70_000, text="body", key="id").collect()
    assert {s.width for s in made} == {4}
    last = {r.key: np.frombuffer(r.ids, "<u4")[-1] for r in tokenfiles.read_tokens(spark, wide).collect()}
    assert last == {5: 70_000, 4: 70_000}


def test_token_file_query_is_the_library(spark):
    from premia.llm import all_queries
    from premia.llm.common import read

    library, at = Tokenizer.from_file(word_file()), 0
    found = {r.doc_id: r for r in all_queries()["op13_token_files"](spark, "/root/testdata/sf0.001").collect()}
    docs = sorted(read(spark, "/root/testdata/sf0.001", "documents").collect(), key=lambda r: r.doc_id)
    assert len(found) == len(docs)
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        r = found[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


TRICKY = [
    "", " ", "H̱ Å K İstanbul ΣΣ ÉCOLE ǅ",
    "<|STARTOFTEXT|> <|startoftext|>x<|endoftext|>", "a\0b \0 \0\0 c", "a b　c\x1cd\x85e", "́x ́",
    "It's I'LL don't 3.14 $5,000 ###", "x" * 5000 + " " + "é" * 300, "\U0001f600\U0001f601 ﬁ ẛ̣",
]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(file, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokenfiles, "REMEMBERED", 30)  # forgets between calls
    path = public_tokenizers.path(file)
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as content:
        encoder = tokenfiles.Encoder(content.read(), (7, 8))
    assert encoder.drops_space == file.startswith("word")
    rows = [TRICKY, [], *[[" ".join(TRICKY[: k + 1])] * 2 for k in range(len(TRICKY))], ["plain Words again"] * 3]
    for texts in rows:
        ids, lengths = encoder.encode(texts)
        expected = [[*library.encode(t, add_special_tokens=False).ids, 7, 8] for t in texts]
        assert lengths.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_encoder_takes_every_character():
    with open(word_file(), encoding="utf-8") as content:
        encoder = tokenfiles.Encoder(content.read())
    library = Tokenizer.from_file(word_file())
    for start in range(0, 0x30000, 0x400):
        own = [chr(c) for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000]
        for text in (" ".join(own), "Ab".join(own)):
            assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
