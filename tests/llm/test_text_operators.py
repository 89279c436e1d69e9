import collections
import itertools
import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from premia.llm import all_queries, bpe, decontaminate, minhash, substrings, suffixes, toxicity
from premia.llm.common import write_table
from premia.llm.components import components
from premia.llm.queries import bpe_file

VOCABULARY = bpe.Vocabulary(bpe.content_of(bpe_file()))


def by_id(rows):
    return {r["doc_id"]: tuple(r)[1:] for r in rows if r["doc_id"] is not None}


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(60, 70), (70, 60)]])
def test_components(spark, links):
    found = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == brute.lowest({x for link in real for x in link}, real)


def test_bpe_is_the_library(documents, odd_texts):
    library = Tokenizer.from_file(bpe_file())
    encoded = bpe.encode_texts(documents.select("doc_id", "text", "ids", "score"), bpe_file())
    found = bpe.decode_ids(encoded, bpe_file()).collect()
    assert len(found) == len(odd_texts) + 2
    expected = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in odd_texts}
    for r in found:
        if r.doc_id is not None:
            ids = [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
            assert ids == expected[r.doc_id]
            assert r.decoded == library.decode(ids, skip_special_tokens=False) and r.score == 8.0


def test_bpe_every_character_and_long_texts():
    library, own = Tokenizer.from_file(bpe_file()), bpe.Vocabulary(bpe.content_of(bpe_file()))
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)}  {chr(c)} x" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["word " * 300_000, "ab" * 30_000, "\n \t" * 2000, "é" * 5000 + " " * 5000]
    for text, ids, encoding in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in encoding.ids), text[:50]
        assert own.decode(ids) == text


def test_bpe_cuts_are_where_no_token_has_the_pair():
    own = bpe.Vocabulary(bpe.content_of(bpe_file()))
    for token in own.tokens[:5000]:
        assert all(own.inside[a << 8 | b] for a, b in zip(token, token[1:], strict=False))
    held = {pair for token in own.tokens[:-1] for pair in zip(token, token[1:], strict=False)}
    assert own.inside.sum() == len(held)


@given(st.lists(st.text(alphabet="ab1'.  \n\t\x1c\u3000\u0301é\U0001f600<|endoftext|>", max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_bpe_of_any_text_in_small_pieces_with_a_short_memory(texts):
    library, own = Tokenizer.from_file(bpe_file()), VOCABULARY
    texts = [*texts, "<|endoftext|>".join(texts) * 2]
    before, bpe.PIECE = bpe.PIECE, 5
    own.known.most = own.fragments.most = 8
    try:
        found = own.encode(texts)
    finally:
        bpe.PIECE = before
    ids = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert found == [b"".join(i.to_bytes(4, "little") for i in x) for x in ids]


def test_bpe_passes_other_columns_through(spark):
    table = spark.createDataFrame([("a b", 1, 2), (None, 3, 4), ("", 5, 6)], "text string, _ids int, decoded int")
    found = bpe.decode_ids(bpe.encode_texts(table, bpe_file()), bpe_file())
    assert found.columns == ["_ids", "ids", "decoded"]
    assert sorted((r[0], len(r.ids), r.decoded) for r in found.collect()) == [(1, 8, "a b"), (3, 0, ""), (5, 0, "")]
    assert bpe.decode_ids(bpe.encode_texts(table.limit(0), bpe_file()), bpe_file()).count() == 0


def test_bpe_encodes_and_decodes_in_one_step(spark, documents):
    both = bpe.encode_texts(documents.select("doc_id", "text", "score"), bpe_file(), decoded="decoded")
    apart = bpe.decode_ids(bpe.encode_texts(documents.select("doc_id", "text", "score"), bpe_file()), bpe_file())
    assert sorted(both.select(*apart.columns).collect(), key=str) == sorted(apart.collect(), key=str)
    table = documents.select("doc_id", "lang", "source", "text")
    tokens = dict(corpus_pipeline.STAGES)["tokens"](spark, table, "")
    query = all_queries()["op10_bpe"](spark, "/root/testdata/sf0.001")
    # A task has one worker with one vocabulary: a second step would have a second worker beside it.
    assert [x._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for x in (both, tokens, query)] == [1, 1, 1]


def test_substrings(documents, odd_texts, no_documents):
    found = substrings.remove_repeats(documents, carry=("lang",)).collect()
    assert {k: v[:3] for k, v in by_id(found).items()} == brute.without_repeats(odd_texts)
    assert len(found) == len(odd_texts) + 2 and {r.lang for r in found} == {"en"}
    (nameless,) = [r for r in found if r.doc_id is None]
    assert nameless.n_removed == 0 and nameless.n_words > 0
    assert substrings.remove_repeats(no_documents).collect() == []


def test_suffixes(documents, odd_texts, no_documents):
    found = suffixes.repeated_passages(documents).collect()
    covered = {(r.doc_id, k) for r in found for k in range(r.start, r.start + r.n_words)}
    assert covered == brute.repeated_words(odd_texts)
    texts = {i: brute.ascii_words(t) for i, t in odd_texts}
    for r in found:
        own, other = texts[r.doc_id][r.start : r.start + 50], texts[r.other_doc_id][r.other_start : r.other_start + 50]
        assert own == other and r.doc_id != r.other_doc_id
    assert suffixes.repeated_passages(no_documents).collect() == []


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(documents, odd_texts, no_documents, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    found = minhash.near_duplicates(documents).collect()
    assert len(found) == len(odd_texts) + 2
    assert by_id(found) == brute.near_duplicates(odd_texts)
    assert minhash.near_duplicates(no_documents).collect() == []


def test_sketches_estimate_the_similarity():
    import numpy as np

    rng = np.random.default_rng(5)
    for n, kind in ((30, 0), (57, 0), (400, 1)):
        errors = []
        for _ in range(60):
            x = rng.integers(0, 2**63, n + n // 10, dtype=np.uint64)
            a, b = x[:n], x[n // 10 :]
            equal = (minhash.sketch(a, bool(kind)) == minhash.sketch(b, bool(kind))).mean()
            true = (n - n // 10) / (n + n // 10)
            errors.append((equal - minhash.COLLISION) / (1 - minhash.COLLISION) - true)
        assert abs(np.mean(errors)) < 0.03 and np.min(errors) > minhash.lowest_estimate(0.85) - 0.85
    assert sorted(minhash.BANDS.ravel().tolist()) == list(range(128))


@pytest.mark.parametrize("slop", [0, 2])
def test_passages(spark, documents, odd_texts, no_documents, slop):
    texts = dict(odd_texts)
    passage = texts[40].split()[30:55]
    items = [(1, " ".join(passage)), (2, "ONE, two!"), (3, None), (4, " .,- "), (None, "a b c"), (5, "c d e"), (10, texts[14][900:1400]),
             (1, "same " * 14), (7, "nowhere to be found"), (5, "c d e"), (12, " ".join([*passage[:4], "same", *passage[4:8]]))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    found = decontaminate.find_passages(documents, benchmark, slop=slop).collect()
    assert len(found) == len(odd_texts) + 2
    assert {i: v[:3] for i, v in by_id(found).items()} == brute.passages(odd_texts, items)
    for r in found:
        assert set(r["items"]) <= set(r.near_items)
    if slop:
        assert any("12" in r.near_items and "12" not in r["items"] for r in found)
    assert decontaminate.find_passages(no_documents, benchmark).collect() == []
    none = decontaminate.find_passages(documents, benchmark.where("false")).collect()
    assert {r.n_hit for r in none} == {0}


def toxic_rows(n):
    from conftest import prose

    rows = []
    for i in range(n):
        words = prose(1000 + i, 40 + 13 * (i % 30))
        if i % 8 == 0:
            words[i % len(words)] = ("scumbag", "loserish", "idiotic")[i % 3] + str(i % 7)
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    return rows


def test_toxicity(spark, documents, no_documents):
    rows = toxic_rows(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (None, "w1 w2", "x"), (1, rows[1][1], "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(1, None, 1), (2, 7, 1), (None, 1, 1), (3, 0, 1)], "doc_id long, toxic int, score int")
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.predicted for r in found if r.doc_id in (9001, 9002)} == {0}
    assert toxicity.score_toxicity(no_documents, labels).collect() == []
    unlabelled = toxicity.score_toxicity(documents, labels.where("false")).collect()
    assert len(unlabelled) == documents.count() and {r.predicted for r in unlabelled} == {0}


def test_spellings_and_counts(spark):
    number, words, text = toxicity.spellings(["Ab  abcdefgh", "", "x"])
    spelled = [int(x).to_bytes(8, "big").lstrip(b"\0").decode() for x in number]
    assert spelled == [" a", " ab", " ab ", " a", " ab", " abc", " abcd", " abcde", " abcdef", "abcdefg", "bcdefgh", "cdefgh ", " x", " x "]
    assert words.tolist() == [0, 3, 12] and text.tolist() == [0, 0, 2]
    table = spark.createDataFrame([("ab ab", 0), ("ab", 2), ("b", 1)], "text string, place int")
    counts = {int(r.spelling): tuple(r)[1:] for r in toxicity.spelling_counts(table).collect()}
    assert counts[int.from_bytes(b" ab", "big")] == (3, 0, 1, 0, 0)
    assert counts[int.from_bytes(b" b", "big")] == (1, 1, 0, 0, 0)
    assert sum(c[0] for c in counts.values()) == 11
    assert collections.Counter(c[1] > 0 for c in counts.values())[True] == 2


def test_likelihoods_sum_to_one(spark):
    rows = [(t, p) for p in (1, 2) for t in ("abc abd", "abe", "zz ab")]
    counts = toxicity.spelling_counts(spark.createDataFrame(rows, "text string, place int"))
    found = toxicity.differences(counts).agg(F.max(F.abs("part")), F.count("*")).first()
    # Equal texts in both classes: no spelling speaks for either.
    assert found[0] < 1e-12 and found[1] > 5


@pytest.mark.parametrize("sent", [1 << 19, 3, 0])
def test_every_spelling_keeps_its_own_difference(spark, monkeypatch, sent):
    monkeypatch.setattr(toxicity, "SENT_WORDS", sent)
    monkeypatch.setattr(toxicity, "SENT_SPELLINGS", 4 * sent)
    # Two words whose spellings were one slot of the former table of 8,388,593 slots.
    slot: dict[int, str] = {}
    for word in map("".join, itertools.product("abcdefghijklmnop", repeat=4)):
        number = int(toxicity.spellings([word])[0][3]) % 8_388_593
        if number in slot and slot[number][0] != word[0]:
            break
        slot[number] = word
    frequent, rare = slot[number], word
    labelled = [(f"{frequent} so it is", 2 - i % 2 * 2 + 1) for i in range(0, 40, 2)] + [(f"{frequent} it", 1)] * 20 + [(f"so {rare}", 2)] * 2
    words = toxicity.word_counts(spark.createDataFrame([*labelled, ("unseen wordsx", 0)], "text string, place int")).cache()
    difference = toxicity.differences(toxicity.totals(words))
    of = {int(r.spelling): (r.part, r.full) for r in difference.collect()}
    values = toxicity.word_values(words, difference).cache()

    def mean(word, which):
        numbers = toxicity.spellings([word])[0]
        return sum(of[int(x)][which] for x in numbers) / len(numbers)

    texts = [frequent, rare, f"{rare} {frequent}", "unseen", "so it is", "unseen wordsx", " ", None, f"IS {rare.upper()}"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r.i: (r.part, r.full) for r in toxicity.strongest_words(table, values, ["i"]).collect()}
    for i, text in enumerate(texts):
        expected = [max((mean(w, k) for w in (text or "").lower().split()), default=0) for k in range(2)]
        assert found[i] == pytest.approx(expected)
    assert found[1][1] > 0.5 > found[0][1]


def test_alike_sets_beside_the_border_meet_at_80_percent(spark):
    words = [f"w{k}" for k in range(62)]
    # 48 and 58 shingles, all of the smaller set in the larger.
    table = spark.createDataFrame([(1, " ".join(words[:52])), (2, " ".join(words))], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(table, percent=80).collect()} == {1}
    assert {r.component_id for r in minhash.near_duplicates(table).collect()} == {1, 2}


def test_passages_that_neighbours_leave_open(spark):
    """Documents share 40 words; only some share the five before and the five after them too."""
    shared, rows = prose_words(7, 40), []
    before = [prose_words(100 + k, 5) for k in range(30)]
    after = [prose_words(200 + k, 5) for k in range(30)]
    pairs = [(i, j) for i in range(30) for j in range(30)]
    pairs += pairs[::45]
    for n, (i, j) in enumerate(pairs):
        rows.append((n, " ".join([*prose_words(1000 + n, 20), *before[i], *shared, *after[j], *prose_words(5000 + n, 20)])))
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffixes.repeated_passages(documents).collect()
    covered = {(r.doc_id, k) for r in found for k in range(r.start, r.start + r.n_words)}
    expected = brute.repeated_words(rows)
    assert len({i for i, _ in expected}) == 2 * len(pairs[::45][:20])
    assert covered == expected
    texts = {i: t.split() for i, t in rows}
    for r in found:
        assert texts[r.doc_id][r.start : r.start + 50] == texts[r.other_doc_id][r.other_start : r.other_start + 50]


def prose_words(seed, n):
    from conftest import prose

    return prose(seed, n, 10**6)


def test_passages_of_random_mixtures(spark):
    """Few words in many combinations, so that keys have many contexts which agree in part."""
    rng = random.Random(4)
    pieces = [prose_words(k, n) for k, n in enumerate([3, 4, 6, 9, 12, 25, 30])]
    rows = [(i, " ".join(w for _ in range(12) for w in rng.choice(pieces))) for i in range(150)]
    found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    covered = {(r.doc_id, k) for r in found for k in range(r.start, r.start + r.n_words)}
    assert covered == brute.repeated_words(rows)


def test_only_windows_that_neighbours_leave_open_are_looked_up(spark):
    rng = random.Random(5)
    pieces = [prose_words(k, n) for k, n in enumerate([3, 4, 6, 9, 12, 25, 30])]
    rows = [(i, 0, " ".join(w for _ in range(12) for w in rng.choice(pieces))) for i in range(120)]
    texts = spark.createDataFrame(rows, "doc_id long, print int, text string")
    keys = suffixes.suffix_keys(texts, 50).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    table = write_table(suffixes.suffixes(texts.join(keys, "doc_id"), 50), "suffixes")
    _, least = suffixes.neighbour_matches(table, 50, ["after", "before"])
    _, most = suffixes.neighbour_matches(table, 50, ["before", "after"])
    lowest = {(r.doc_id, r.first): r.bound for r in least.collect()}
    highest = {(r.doc_id, r.first): r.bound for r in most.collect()}
    found = suffixes.open_windows(table, least, most, 50).collect()
    assert found
    for r in found:
        place = r.doc_id, r.at[0]
        assert place in lowest and place in highest and lowest[place] <= r.left <= highest[place]
