import math
import re

import brute
import numpy as np
import pytest

from premia.llm import embeddings, licences, preferences, urls


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
             ("a.org", "/fr", "block"), ("", "/ads/", "block"), ("tie.com", "/ab", "allow"), ("e.com", "/ab/", "block")]
    cases = [None, "", "no scheme", "http://", "http://X.Example.NET/en/a?b", "https://example.net/EN/", "http://example.net",
             "http://net/", "http://notexample.com/de/x", "http://m.example.com/de/", "http://example.com:80/de/", "x://a.org/fr/x#y",
             "x://b.a.org/frog", "http://q.com/ads/1", "http://tie.com/ab/", "http://É.net/é?x", "a://b://c.net/", "http://u.net\n/x"]
    rows = [(i, u, "h") for i, u in enumerate(cases)] + [(4, cases[4], "h"), (None, cases[7], "h"), (99, "http://" + "a." * 5000 + "net/", "h")]

    def expected(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0].translate(brute.LOWER)
        path = re.match("[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r in rules if (not r[0] or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
        return (host, path, best and best[0] + best[1], best[2] if best else "allow")

    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = sorted((tuple(r) for r in urls.judge_urls(pages, rules).collect()), key=str)
    assert found == sorted(((i, *expected(u)) for i, u, _ in rows), key=str)
    assert urls.judge_urls(pages.where("false"), rules).collect() == []
    assert {r.verdict for r in urls.judge_urls(pages, []).collect()} == {"allow"}


def test_urls_index_holds_the_rarest_token(spark):
    rows = urls.rule_rows([("example.net", "/en/x", "allow")])
    assert rows[0][-1] == [".example", ".net", "/en"]


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), rng.standard_normal(12).tolist()) for i in range(120)]
    centre = rng.standard_normal(12)
    for i in range(120, 190):
        rows.append((i, 1, (centre + rng.standard_normal(12) * 0.12).tolist()))
    rows += [(200 + k, k % 2, rows[5][2]) for k in range(6)] + [(210, 1, [2 * x for x in rows[130][2]])]
    return rows + [
        (300, None, rows[0][2]), (301, 0, None), (302, 0, []), (303, 0, [0.0] * 12), (304, 0, [float("nan")] * 12),
        (305, 0, [float("inf")] + [1.0] * 11), (306, 0, [None] + [1.0] * 11), (307, 0, [1.0, 2.0]), (308, 0, [1.0, 2.0]),
    ]


@pytest.mark.parametrize("block", [256, 16])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    schema = "vec_id long, label int, embedding array<float>, node int"
    table = spark.createDataFrame([(*r, 1) for r in rows] + [(*rows[3], 1), (None, 0, rows[0][2], 1)], schema)
    single = [(i, s, v and [None if x is None else float(np.float32(x)) for x in v]) for i, s, v in rows]
    found = embeddings.near_vectors(table).collect()
    assert len(found) == len(rows) + 1
    assert {r.vec_id: tuple(r)[1:] for r in found if r.vec_id is not None} == brute.near_vectors(single)
    assert embeddings.near_vectors(table.where("false")).collect() == []


def two_dense_groups():
    rng = np.random.default_rng(11)
    centres = np.eye(32)[:2]
    centres[1] = 0.96 * centres[0] + math.sqrt(1 - 0.96**2) * centres[1]
    x = np.repeat(centres, 150, axis=0) + rng.standard_normal((300, 32)) * 0.023
    return [(i, 0, v) for i, v in enumerate(x.tolist())]


def test_links_beyond_the_lists_still_connect(spark, monkeypatch):
    # Each vector has more nearer neighbours on its own side than a list holds.
    monkeypatch.setattr(embeddings, "MOST", 12)
    rows = two_dense_groups()
    single = [(i, s, [float(np.float32(x)) for x in v]) for i, s, v in rows]
    expected = brute.near_vectors(single)
    assert {low for _, low, _ in expected.values()} == {0} and min(n for n, *_ in expected.values()) > 150
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert {r.vec_id: tuple(r)[1:] for r in found} == expected


def test_embedding_audit_counts_what_is_missing(spark):
    table = spark.createDataFrame([(i, 0, [1.0, i / 1000]) for i in range(10)], "vec_id long, label int, embedding array<float>")
    _, classes = embeddings.classes_of(table)
    full = spark.createDataFrame([(i, 9) for i in range(10)], "node long, n_links long")
    assert embeddings.audit(classes, full, 0.93) == 1.0
    assert embeddings.audit(classes, full.where("node < 5"), 0.93) == 0.5


def test_preferences(spark):
    talk = lambda c, *turns: [(c, k, *t, "p") for k, t in enumerate(turns)]
    u, v = ("user", "hi"), ("assistant", "yes")
    rows = [*talk(1, u, v, ("user", "more"), ("assistant", "no")), *talk(2, u, ("assistant", "maybe")), *talk(3, u, v), *talk(4, ("user", "alone")),
            *talk(5, u, v, ("user", "more"), ("assistant", "no")), *talk(6, (None, None), v, v), (2, 0, *u, "p"), (None, 0, *u, "p"),
            (7, None, "assistant", "first", "p"), (7, 1, "user", "x" * 50000, "p"), (7, 1, "assistant", "tie", "p")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    found = {(r.chosen_id, r.rejected_id): r for r in preferences.format_pairs(preferences.pair_conversations(table)).collect()}
    assert set(found) == {(1, 2), (1, 3), (1, 5), (1, 1), (5, 5), (7, 7)}
    r = found[1, 2]
    assert r.n_common == 1 and r.prompt == "<|user|>\nhi<|end|>\n"
    assert "".join(x.text for x in r.rejected) == "<|assistant|>\nmaybe<|end|>\n"
    assert [x.text for x in r.chosen if x.trained] == ["yes<|end|>\n", "no<|end|>\n"]
    assert found[1, 3].n_common == 2 and found[1, 3].rejected == []
    assert found[1, 5].n_common == 4 and found[1, 5].chosen == found[1, 5].rejected == []
    assert found[1, 1].n_common == 3 and [x.text for x in found[1, 1].rejected if x.trained] == ["yes<|end|>\n"]
    assert found[7, 7].n_common == 1 and "first" in found[7, 7].prompt
    assert preferences.pair_conversations(table.where("false")).collect() == []


def brute_licences(files, licence_files, least):
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    terms = {w for _, t in licences.TEMPLATES for w in words(t)}
    held = {w: sum(w in words(t or "") for _, t in files) for w in terms}
    idf = lambda w: math.log((1 + len(files)) / (1 + held.get(w, 0))) + 1

    def vector(ws):
        return {w: ws.count(w) * idf(w) for w in ws}

    own = {}
    for path, text in files:
        for line in re.split(r"[\r\n]+", text or ""):
            a = vector(words(line))
            for name, template in licences.TEMPLATES:
                b = vector(words(template))
                norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                score = sum(x * b.get(w, 0) for w, x in a.items()) / norm if norm else 0
                if score >= least:
                    own[path] = min(own.get(path, (0, "")), (-round(score, 9), name))
    folders = {}
    for path, (_, name) in own.items():
        if re.search(licence_files, path.split("/")[-1]):
            folders.setdefault("/".join(path.split("/")[:-1]), []).append(name)
    out = {}
    for path, _ in files:
        parts = path.split("/")[:-1]
        above = ["/".join(parts[:k]) for k in range(len(parts), -1, -1)]
        at = next((f for f in above if f in folders), None)
        best = at is not None and min((-folders[at].count(n), n) for n in folders[at])[1]
        out[path] = (own[path][1], own[path][1], None) if path in own else (None, best or None, at)
    return out


def test_licences(spark):
    notices = dict(licences.TEMPLATES)
    files = [("LICENSE", notices["MIT"]), ("a/LICENSE", "Header\n" + notices["GPL-3.0"] + "\nmore"), ("a/LICENSE.2", notices["MIT"]),
             ("a/LICENSE.3", notices["MIT"]), ("a/b/c/x.py", "plain"), ("a/b/y.py", notices["Apache-2.0"].upper() + "\r\n" + "word " * 30000),
             ("top", ""), ("a/z", "licensed under something else entirely by nobody in the world"), ("b/LICENSE", "nothing"), ("b/q", "x"),
             ("a/b/LICENSE", "Released under MIT License"), ("c//d", "All rights reserved"), ("é/LICENSE", notices["CC-BY-NC-4.0"]), ("é/x", "y")]
    rows = [(p, t, "x") for p, t in files] + [("b/q", "x", "x"), (None, notices["MIT"], "x"), ("null", None, "x")]
    table = spark.createDataFrame(rows, "path string, text string, licence string")
    found = {r.path: (r.own_licence, r.licence, r.inherited_from) for r in licences.scan_licences(table, "^LICENSE").collect()}
    counted = [*files, ("b/q", "x"), ("null", None)]
    assert found == brute_licences(counted, "^LICENSE", 0.7)
    assert licences.scan_licences(table.where("false"), "^LICENSE").collect() == []


def test_licence_lines_without_a_telling_term_stay_below():
    idf = {"a": 1.0, "b": 2.0, "c": 0.5}
    assert licences.telling_terms([idf], 0.7) == ["b"]
    assert licences.telling_terms([idf], 0.1) == ["a", "b", "c"]


def test_isolated_pairs_are_met(spark):
    """Pairs without common neighbours among very many vectors of one label."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(100):
        across = rng.standard_normal(64)
        across -= across @ x[k] * x[k]
        x[5900 + k] = 0.935 * x[k] + math.sqrt(1 - 0.935**2) * across / np.linalg.norm(across)
    rows = [(i, 0, v) for i, v in enumerate(x.tolist())]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    linked = {r.vec_id: (r.n_links, r.component_id) for r in found if r.n_links}
    assert linked == {i: (1, k) for k in range(100) for i in (k, 5900 + k)}


def test_tables_follow_the_size_of_a_label():
    together = 1 - math.acos(0.93) / math.pi
    for bits in range(0, 30):
        tables = embeddings.tables_for(bits, 0.93)
        assert (1 - together**bits) ** tables <= 1 - embeddings.MET + 1e-12
    assert embeddings.tables_for(0, 0.93) == embeddings.TABLES < embeddings.tables_for(10, 0.93) < embeddings.tables_for(20, 0.93)


def test_audit_without_links_does_not_pass(spark, monkeypatch):
    eye = np.eye(40).tolist()
    table = spark.createDataFrame([(i, 0, v) for i, v in enumerate(eye)], "vec_id long, label int, embedding array<double>")
    _, classes = embeddings.classes_of(table)
    none = spark.createDataFrame([], "node long, n_links long")
    assert embeddings.passes(classes, none, 0.93, 0)  # all vectors were compared
    monkeypatch.setattr(embeddings, "AUDITED", 4)
    monkeypatch.setattr(embeddings, "MOST_AUDITED", 16)
    assert not embeddings.passes(classes, none, 0.93, 0)
    assert embeddings.passes(classes, none, 0.93, 1)
    pair = table.union(spark.createDataFrame([(40, 0, eye[3])], table.schema).selectExpr("vec_id", "label", "transform(embedding, x -> x + 0.001D)"))
    _, classes = embeddings.classes_of(pair)
    monkeypatch.setattr(embeddings, "MOST_AUDITED", 64)
    assert not embeddings.passes(classes, none, 0.93, 1)
