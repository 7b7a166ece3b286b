"""The text operators: against brute force, libraries and DuckDB on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelloom.llm import ann, chat, decontaminate, licenses, neardup, pieces, pii, quality, queries, tokencount, toxicity
from pixelloom.llm.common import bucket_of

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "A b", "a b c", "x" * 5000, "word " * 4000, "日本語🙂 é á", "<|endoftext|> x", "  two  spaces\t\ttab", "\x00", "Same text here again", "Same text here again"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, digest string, word string, matches string, score string, ids string"


def docs(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "en", None, None, *["clash"] * 7) for i, t in enumerate(texts)], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]


# 1


def test_token_counts(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokencount.default_tokenizer())
    all_texts = ODD + texts
    want = [len(t.encode(x or "", add_special_tokens=False)) for x in all_texts]
    cache = str(tmp_path / "cache")
    for _ in range(2):  # from nothing, then from the cache alone
        got = by_id(tokencount.count_tokens(docs(spark, all_texts), tokencount.default_tokenizer(), cache))
        assert [got[i].n_tokens for i in range(len(want))] == want
        assert spark.read.parquet(cache).groupBy("digest").count().where("count > 1").count() == 0
    assert all(got[i].n_bytes == len((x or "").encode()) and got[i].over_limit == (want[i] > 2048) for i, x in enumerate(all_texts))
    assert tokencount.count_tokens(docs(spark, []), tokencount.default_tokenizer()).count() == 0


# 2


def test_pieces(spark, texts):
    sp = pieces.library(pieces.default_model())
    rng = np.random.default_rng(3)
    parts = ["the", "a", " ", "  ", "\n", "er", "ZZ", "é", "▁", "🙂", "0", "12", "\t", "ing", "   ", "x" * 70]
    made = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(200)]
    all_texts = ODD + made + texts
    encoded = pieces.encode(docs(spark, all_texts), hot=500)
    got = by_id(encoded)
    assert all(list(got[i].ids) == sp.encode(x or "") for i, x in enumerate(all_texts))
    back = by_id(pieces.decode(encoded))
    assert all(back[i].text == sp.decode(sp.encode(x or "")) for i, x in enumerate(all_texts))
    assert pieces.encode(docs(spark, [])).count() == 0


def test_pieces_without_dictionary(spark):
    """Every part through the lattice; rows that are equal, kept columns named like inner ones, texts without spaces, parts beyond the mask, runs of spaces before unknown parts."""
    sp = pieces.library(pieces.default_model())
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyzäéABC")
    long = "".join(rng.choice(letters, 300_000))
    texts = ["same text"] * 300 + [long, long, "日本語" * 500, "=" * 200, "x  " + "".join(rng.choice(letters, 20)), " " * 9 + "qzvx", "qzvx" + " " * 7, "".join(rng.choice(letters, 59)), "".join(rng.choice(letters, 62))]
    rows = [(None if i % 3 else i, t, "k", "w", i, "ids") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, word string, row int, own string")
    got = pieces.encode(df, keep=("doc_id", "key", "word", "row", "own", "text"), hot=0).collect()
    assert len(got) == len(texts) and {r.row for r in got} == set(range(len(texts)))
    assert all(list(r.ids) == sp.encode(texts[r.row]) and r.text == texts[r.row] and r.key == "k" and r.own == "ids" for r in got)
    plain = spark.createDataFrame([(1, [5, 99999, None, -1, 300]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(plain).collect()} == {1: sp.decode([5, 300]), 2: "", 3: ""}


# 3


def brute_viterbi(model, seen):
    best = [(0.0, ())]
    import itertools

    best = max(((sum(model.matrix(s)[p[i - 1] if i else 3, p[i]] for i, s in enumerate(seen)), tuple(-x for x in p)) for p in itertools.product(range(3), repeat=len(seen))))
    return [-x for x in best[1]]


@pytest.mark.parametrize("block", [2, 3, 256])
def test_roles(spark, block):
    model = chat.Model(np.log([0.2, 0.5, 0.3]), np.log([[0.1, 0.8, 0.1], [0.05, 0.15, 0.8], [0.1, 0.6, 0.3]]), {}, np.log([0.2, 0.4, 0.4]))
    seen = ["User: hi", "Bot: yes", "what?", "fine " * 30, "ok", "Assistant: so", None, ""]
    rows = [(c, i, t, "user", "clash") for c in (1, 2) for i, t in enumerate(seen[: 8 - c])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, state string")
    kinds = {(r.text, r.turn): r.s for r in df.select("text", "turn", chat.symbol(F.col("text"), F.col("turn") == 0).alias("s")).collect()}
    rng = np.random.default_rng(1)
    model.emit = {s: np.log(rng.dirichlet([1, 1, 1])) for s in set(kinds.values())}
    got = {(r.conv_id, r.turn): r for r in chat.recover_roles(df, model, block=block).collect()}
    for c in (1, 2):
        want = brute_viterbi(model, [kinds[t, i] for i, t in enumerate(seen[: 8 - c])])
        assert [got[c, i].role for i in range(8 - c)] == [chat.ROLES[s] for s in want]
    r = got[1, 0]
    assert r.rendered == f"<|{r.role}|>\nhi\n<|end|>\n"


def test_roles_on_tables(spark):
    p = queries.op3_chat_format(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert (p.given == p.role).mean() > 0.9
    empty = spark.createDataFrame([], "conv_id long, turn long, text string, role string")
    assert chat.recover_roles(empty, chat.fit(empty)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "a", "user"), (1, 0, "a", "user")], "conv_id long, turn long, text string, role string")
    assert chat.recover_roles(odd, chat.fit(odd)).count() == 3


def test_markers(spark):
    """Only a marker goes: a name with a colon, in brackets, or as a heading."""
    says = {
        "User: hi": "hi", "[assistant] x": "x", "**System:** y": "y", "**User**: z": "z", "### Human\nhello": "hello", "Q: what?": "what?", "<|assistant|>": "<|assistant|>",
        "AI-driven design": None, "User-friendly apps": None, "a > b holds": None, "(a) first": None, "<a> link": None, "# Userland": None, "### assistant hello": None, "answer the question": None, "Bots: many": None,
    }
    df = spark.createDataFrame([(i, 0, t, "user") for i, t in enumerate(says)], "conv_id long, turn long, text string, role string")
    got = {r.conv_id: r.rendered.split("|>\n", 1)[1].rsplit("\n<|end|>", 1)[0] for r in chat.recover_roles(df, chat.fit(df)).collect()}
    assert [got[i] for i in range(len(says))] == [v or k for k, v in says.items()]


@pytest.mark.parametrize("block", [2, 256])
def test_start_of_conversations(spark, block):
    """The first row starts a conversation, whatever its number; equal rows without an id are dealt to several tasks."""
    model = chat.Model(np.log([0.01, 0.98, 0.01]), np.log([[0.1, 0.1, 0.8], [0.1, 0.1, 0.8], [0.1, 0.8, 0.1]]), {}, np.log([1 / 3] * 3))
    rows = [(1, t, "x", "user") for t in (5, 6, 7)] + [(None, None, "same", "user")] * 40
    got = chat.recover_roles(spark.createDataFrame(rows, "conv_id long, turn long, text string, role string"), model, block=block).collect()
    assert [r.role for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)] == ["user", "assistant", "user"]
    assert Counter(r.role for r in got if r.conv_id is None) == {"user": 20, "assistant": 20}


# 4 and 7


def held_out(spark, query, label):
    p = query(spark, "/root/testdata/sf0.1").toPandas()
    x = duckdb.sql("SELECT * FROM '/root/testdata/sf0.1/labels.parquet'").df().merge(p, on="doc_id")
    x = x[x.held_out]
    return x[label] == 1, x.predicted == 1


def test_quality(spark):
    good, kept = held_out(spark, queries.op4_quality_classifier, "quality")
    assert kept[good].mean() > 0.97 and (~kept[~good]).mean() > 0.9
    none = quality.QualityModel()
    assert {r.score for r in quality.score(docs(spark), none).collect()} == {0.5}
    d, labels = docs(spark, ["good calm words here"] * 8 + ["BAD!!! ### %%%"] * 8 + ODD), spark.createDataFrame([(i, int(i < 8), None) for i in range(16)] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.QualityModel.fit(d, labels)
    got = by_id(quality.score(d, model))
    assert len(got) == 16 + len(ODD) and all(0 <= r.score <= 1 for r in got.values()) and got[16].score == got[17].score
    assert quality.keep_good(d, model).columns == d.columns and quality.score(docs(spark, []), model).count() == 0


def test_toxicity(spark):
    toxic, flagged = held_out(spark, queries.op7_toxicity, "toxic")
    assert flagged[toxic].mean() > 0.75 and flagged[~toxic].mean() < 0.01
    d = docs(spark)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, empty)).collect()} == {0.5}
    got = by_id(toxicity.score(d, (np.array([5]), np.array([1.0]), -1.0)))
    assert len(got) == len(ODD) and abs(got[0].score - 1 / (1 + np.e)) < 1e-12


# 5


def test_licenses(spark, tmp_path):
    mit = "Copyright (c) 2020 Somebody\n\n" + licenses._MIT_GRANT.upper().replace(" ", "  ")
    t = [*ODD, mit, "x\n released under the MIT licence \ny", "Released under the MIT License", "(c) me\nReleased under the MIT License!"]
    got = by_id(licenses.scan(docs(spark, t)))
    n = len(ODD)
    assert (got[n].licence, got[n].licences) == ("MIT", "MIT") and (got[n + 1].licence, got[n + 1].n_lines) == (None, 1)
    assert got[n + 2].licence == "MIT" and got[n + 3].licence == "MIT" and all(got[i].licences == "" for i in range(n))
    pd.DataFrame({"doc_id": range(len(t)), "text": t}).to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = {r[0]: r[1:] for r in con.execute(licenses.oracle_sql()).fetchall()}
    assert want == {i: (r.licence, r.n_lines, r.licences) for i, r in got.items()}
    assert licenses.scan(docs(spark, [])).count() == 0


# 6


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for name, t in items:
        q = words(t)
        n = min(window, len(q))
        for i in range(len(q) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == q[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 150])
def test_decontamination(spark, block_bytes):
    rng = np.random.default_rng(5)
    vocabulary = ["a", "B", "c1", "é", "dd"]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 25])] + [(7, None), (8, "!?"), (9, "zz yy"), (9, "zz yy")]
    t = [*ODD, *("-".join(rng.choice(vocabulary, 60)) for _ in range(20)), "ZZ, yy! " + items[6][1].replace("d", "D")]
    bench = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, matches int")
    got = by_id(decontaminate.find_matches(docs(spark, t), bench, block_bytes=block_bytes))
    for i, x in enumerate(t):
        r = got[i]
        assert (r.n_words, r.n_hit, sorted({m["item"] for m in r.matches})) == brute_hits(x, items)
    long = max((m for m in got[len(t) - 1].matches if m["item"] == "6"), key=lambda m: m["n_words"])
    assert long["n_words"] == 25 and long["item_start"] == 0 and long["doc_start"] == 2
    kept = decontaminate.remove_contaminated(docs(spark, t), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.n_hit} and kept.columns == docs(spark).columns
    assert decontaminate.find_matches(docs(spark), bench.where("false")).where("n_hit > 0").count() == 0


# 8


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(fps, most=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark, texts):
    all_texts = ODD + texts[:120] + [texts[0].upper(), texts[1] + " end"]
    got = by_id(neardup.near_duplicates(docs(spark, all_texts)))
    fps = [brute_fingerprint(t) for t in all_texts]
    assert [got[i].fingerprint for i in range(len(fps))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(fps))] == brute_components(fps)
    one = neardup.keep_one(docs(spark, all_texts).unionAll(docs(spark, all_texts)))
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(brute_components(fps))) and one.columns == docs(spark).columns
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_links_of_large_groups(spark, tmp_path):
    """Lists longer than a group are split and dealt to blocks without losing a link."""
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for base in list(fps)[:3]:
        for _ in range(60):
            x = base
            for b in rng.integers(0, 63, rng.integers(1, 7)):
                x ^= 1 << int(b)
            fps.add(x)
        fps |= {base ^ i for i in range(40)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = neardup.connected_components(neardup.links(nodes, str(tmp_path), group_rows=8), str(tmp_path))
    roots = {r.node: r.root for r in found.collect()}
    assert [roots.get(x, x) for x in fps] == [fps[i] for i in brute_components(fps)]


# 9


def brute_base(text):
    text = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii(spark, texts):
    rng = np.random.default_rng(4)
    bits = ["a", "@", ".", "b.c", "1", "255", "256", "4111 1111 1111 1111", "4111-1111", "+", "+49 (30) 123-45", " ", "-", "é", "🙂", "1.2.3.4", "x@y.z", "%", "_", "00"]
    made = ["".join(rng.choice(bits, rng.integers(1, 25))) for _ in range(800)]
    iban = "My IBAN is DE89370400440532013000, version DE89370400440532013001"
    all_texts = ODD + made + texts + [iban, "+" * 3000, "1" * 3000 + "@", "a@" * 1000, "9." * 2000]
    got = by_id(pii.scan(docs(spark, all_texts)))
    for i, t in enumerate(all_texts):
        assert got[i].base_sha256 == hashlib.sha256(brute_base(t).encode()).hexdigest(), t
    at = len(ODD) + len(made) + len(texts)
    assert got[at].spans == "iban:11:33"
    clean = pii.redact_documents(docs(spark, ["mail x@y.zz or 1.2.3.4", None, "nothing"]))
    assert [r.text for r in clean.orderBy("doc_id").collect()] == ["mail [EMAIL] or [IP]", None, "nothing"] and clean.columns == docs(spark).columns
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")


@pytest.mark.parametrize("before", ["", "IBAN ", "DE12 "])
@pytest.mark.parametrize("iban", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " EUR", " EUR 1200", " 2024", " Konto", " X", ", EUR", "\nBIC", " GB82 WEST 1234 5698 7654 32"])
def test_iban_before_words(before, iban, after):
    spans = [(s["start"], s["end"]) for s in pii.find_spans(before + iban + after) if s["kind"] == "iban"]
    assert spans[:1] == [(len(before), len(before) + len(iban))]
    assert len(spans) == 1 + after.startswith(" GB82")


def test_iban_ends_with_its_word():
    assert not [s for s in pii.find_spans("DE89370400440532013000x DE89370400440532013000A DE89 3704 0044 0532 0130 00a") if s["kind"] == "iban"]


# 10


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    v = base[rng.integers(0, 40, 1500)] + 0.4 * rng.standard_normal((1500, 16))
    v[200:420] = v[200]  # one vector, many rows
    rows = [(i, [float(x) for x in v[i]], None) for i in range(1500)] + [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] * 16, 1), (5150, [1.0], 1), (5200, [None] * 16, 1), (0, [float(x) for x in v[0]], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, half int")
    got = ann.nearest(table, F.col("id") % 50 == 0).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        hit += len(set(want) & set(mine.vec_id))
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and (np.diff(mine.score) <= 1e-12).all()
        assert np.allclose(mine.score, [s[i] for i in mine.vec_id], atol=1e-12)
    assert hit >= 0.9 * 5 * 30 and set(got.query_id) == set(range(0, 1500, 50))
    tiny = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(tiny, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(tiny.where("false"), F.col("id") == 0).count() == 0


def chain(spark, n):
    """A node a degree, each with edges to its two neighbours only."""
    a = np.radians(np.arange(n) * 180 / n)
    half = ann._half(np.stack([np.cos(a), np.sin(a)], axis=1))
    halves = spark.createDataFrame([(i, half[i].tobytes()) for i in range(n)], "id long, half binary")
    edges = spark.createDataFrame([(i, j, float(np.cos(a[1]))) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "node long, id long, sim float")
    return halves, edges


def test_search_goes_on_until_settled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "ENTRIES", 1)
    halves, edges = chain(spark, 36)
    first = halves.orderBy(F.xxhash64("id"), "id").first().id
    far = 0 if first >= 18 else 35
    ask = halves.where(F.col("id") == far).selectExpr("-1L AS query", "half", "cast(null AS long) AS start")
    graph = ann.search_graph(halves, edges, str(tmp_path / "a"))
    found = ann.greedy_search(ask, halves, graph, str(tmp_path / "a"), 2, lambda now: True, beam=2)
    assert found.first().ids[0] == far  # eighteen steps away at least
    with pytest.raises(RuntimeError):
        ann.greedy_search(ask, halves, graph, str(tmp_path / "b"), 2, lambda now: True, beam=2, most_rounds=2)


def test_narrow_beam_finds_neighbours(spark, tmp_path):
    """The graph does the work: a beam of a fortieth of the table, not widened."""
    v = np.random.default_rng(4).standard_normal((2000, 8))
    classes = spark.createDataFrame([(i, v[i].tolist()) for i in range(2000)], "id long, v array<double>")
    ann.short_batches(spark)
    halves, edges = ann.build_graph(classes, str(tmp_path / "g"), 8, 2000, k=12)
    asked = halves.where("id % 50 = 0").selectExpr("id AS query", "half", "id AS start")
    graph = ann.search_graph(halves, edges, str(tmp_path / "g"))
    found = ann.greedy_search(asked, halves, graph, str(tmp_path / "g"), 8, lambda now: True, beam=50).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T - 9 * np.eye(2000)
    hit = sum(len(set(np.argsort(-sims[q])[:5]) & set(x for x in ids if x != q)) for q, ids in zip(found["query"], found["ids"], strict=True))
    assert len(found) == 40 and hit >= 0.9 * 5 * 40
    assert edges.groupBy("node").count().agg(F.max("count")).first()[0] <= 12


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in (9, 3, 7, 5, 8, 1, 2)] + [(0, [1.0, 1.0]), (4, [0.0, 2.0]), (6, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id").isin(0, 9)).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (0, 5, 5), (9, 1, 1), (9, 2, 2), (9, 3, 3), (9, 4, 5), (9, 5, 7)]


def test_beam_grows_until_recall_is_met(spark):
    v = np.random.default_rng(8).standard_normal((900, 24))
    table = spark.createDataFrame([(i, v[i].tolist()) for i in range(900)], "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("id") % 30 == 0, k=8, beam=8).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T - 9 * np.eye(900)
    hit = sum(len(set(np.argsort(-sims[q])[:5]) & set(part.vec_id)) for q, part in got.groupby("query_id"))
    assert hit >= ann.RECALL * 5 * 30


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = SF
    source = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in source.collect()}
    model = quality.QualityModel.fit(source, spark.read.parquet(f"{sf}/labels.parquet"), use=bucket_of("doc_id", 3) != 1)
    press = model.compressor()
    kept = [i for i in sorted(rows) if model.scores([rows[i].text], press)[0] >= 0.5]
    comp = brute_components([brute_fingerprint(rows[i].text) for i in kept])
    kept = [i for k, i in enumerate(kept) if comp[k] == k]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for _, t in bench for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())] for i in range(len(w) - 9)}
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rows[i].text.lower()) for i in kept}
    kept = [i for i in kept if not any(tuple(words[i][j : j + 10]) in grams for j in range(len(words[i]) - 9))]
    sp = pieces.library(pieces.default_model())
    want = {i: sp.encode(pii.redact(rows[i].text, pii.find_spans(rows[i].text))) for i in kept}
    got = {r.doc_id: list(r.ids) for r in cp.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < len(rows)


def test_stages_go_by_row(spark):
    leak = " ".join(f"leak{i}" for i in range(12))
    made = [" ".join(f"{a}{i}" for i in range(40)) for a in ("plum", "stone", "river", "cloud", "amber", "north")]
    rows = [(None, leak), (None, made[0]), (None, made[1]), (7, leak), (7, made[2]), (7, made[3]), (8, made[4]), (9, None)]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    bench = spark.createDataFrame([("b", leak)], "item_id string, text string")
    clean = decontaminate.remove_contaminated(table, bench)
    assert sorted(r.row for r in clean.collect()) == [1, 2, 4, 5, 6, 7] and clean.columns == table.columns
    rows = [(7, made[2]), (7, made[3]), (7, made[3]), (8, made[3]), (8, made[4]), (9, made[5]), (None, made[0]), (None, made[1])]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    one = neardup.keep_one(table)
    got = sorted(((r.doc_id, r.text) for r in one.collect()), key=repr)
    assert got == sorted([(7, made[2]), (7, made[3]), (8, made[4]), (9, made[5]), (None, made[0]), (None, made[1])], key=repr) and one.columns == table.columns


def test_oracle_of_decontamination(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.SQL["op6_decontamination"])
    cols = [c[0] for c in cur.description]
    assert sorted(map(tuple, queries.op6_decontamination(spark, SF).select(*cols).collect())) == sorted(cur.fetchall())


# Odd tables


def odd_documents(spark):
    """Repeated rows, null ids with several texts, and extra columns named like inner ones."""
    rows = [(1, "the same words again and again and again"), (1, "the same words again and again and again"), (2, None), (None, "one text without an id"), (None, "another text without an id"), (None, None), (3, "")]
    names = "label", "own", "rank", "score", "word", "key", "matches", "digest", "licence", "n_tokens", "fp", "component_id", "held_out"
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)), rows


def test_odd_documents(spark):
    df, rows = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(4)] + [(None, 1, 1, "x"), (1, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    many = [(i, f"good words number {i} are fine here" if i % 2 else f"bad noise {i} $$$ ###", "clash") for i in range(40)]
    train, marks = spark.createDataFrame(many, "doc_id long, text string, label string"), spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for learnt in (quality.QualityModel.fit(train, marks), quality.QualityModel.fit(df, labels)):
        scores = quality.score(df, learnt).collect()
        assert len(scores) == 7 and all(0 <= r.score <= 1 for r in scores)
        assert quality.keep_good(df, learnt).columns == df.columns
    for learnt in (toxicity.fit(train, marks), toxicity.fit(df, labels)):
        assert len(toxicity.score(df, learnt).collect()) == 7
    counts = tokencount.count_tokens(df, tokencount.default_tokenizer()).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in counts) == sorted((i or 0, len((t or "").encode())) for i, t in rows)
    assert licenses.scan(df).count() == 7 and pii.scan(df).count() == 7
    assert pieces.encode(df, keep=("doc_id", "label", "own", "word")).columns == ["doc_id", "label", "own", "word", "ids"]
    near = neardup.near_duplicates(df).collect()
    assert len(near) == 7 and {r.component_id for r in near if r.doc_id == 1} == {1}
    bench = spark.createDataFrame([(None, "words again and again and again and again and again"), ("b", "without an id"), ("c", None), (None, None)], "item_id string, text string")
    found = decontaminate.find_matches(df, bench).collect()
    assert sorted(r.n_hit for r in found) == [0, 0, 0, 0, 0, 3, 3] and {m.item for r in found for m in r["matches"]} == {"b"}


def test_unnamed_items(spark):
    text = " ".join(f"w{i}" for i in range(30))
    found = decontaminate.find_matches(docs(spark, [text, "clean"]), spark.createDataFrame([(None, text), ("b", " ".join(text.split()[5:16]))], "item_id string, text string"))
    assert {(m.item, m.n_words) for r in found.collect() for m in r["matches"]} == {(None, 30), ("b", 11)}
    whole = {r.doc_id: (r.n_words, r.n_hit) for r in found.collect()}
    for block_bytes, held in ((1, 1 << 20), (40, 1)):  # many blocks, and a buffer of one batch
        items = spark.createDataFrame([(f"i{k}", " ".join(text.split()[k : k + 12])) for k in range(0, 19, 3)], "item_id string, text string")
        parts = decontaminate.find_matches(docs(spark, [text, "clean"]), items, block_bytes=block_bytes, held_bytes=held).collect()
        assert {r.doc_id: (r.n_words, r.n_hit) for r in parts} == whole


def test_hot_keys(spark):
    """One text of nine rows in ten, by way of the counts that are broadcast and of those that are joined."""
    texts = ["the hot text"] * 900 + [f"rare text {i}" for i in range(1500)]
    got = by_id(tokencount.count_tokens(docs(spark, texts), tokencount.default_tokenizer()))
    assert len(got) == 2400 and {r.n_tokens for i, r in got.items() if i < 900} == {3}


def test_long_lists_of_fingerprints(spark, tmp_path):
    """Lists that every split leaves too long: the last one's bound them."""
    rng = np.random.default_rng(6)
    base = int(rng.integers(1, 2**62))
    fps = sorted({base ^ int(sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 4), replace=False))) for _ in range(400)})
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    neardup.short_batches(spark)
    links = neardup.links(nodes, str(tmp_path / "l"), group_rows=4)
    roots = {r.node: r.root for r in neardup.connected_components(links, str(tmp_path / "l")).collect()}
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {f: roots.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_wrapped_and_commented_licences(spark):
    import textwrap

    texts = dict((k, t) for k, t in licenses.KNOWN if len(t) > 400)
    made, want = [], []
    for name, text in texts.items():
        for width in (40, 55, 61, 68, 79):
            body = "\n".join(textwrap.fill(p, width) for p in text.split("\n"))
            for mark in ("", " * ", "// ", "# "):
                head = ["Copyright (c) 2020 Jane Doe", "Copyright Jane Doe and others", "© 2019 X", "All rights reserved."]
                made.append("\n".join(mark + x for x in [*head, *body.split("\n")]))
                want.append(name)
    got = by_id(licenses.scan(docs(spark, made)))
    assert [got[i].licence for i in range(len(made))] == want
    other = spark.createDataFrame([("Own-1.0", "You may do what you like with this."), (None, "x"), ("y", None)], "licence string, text string")
    assert by_id(licenses.scan(docs(spark, ["YOU MAY DO -- what you like, with this!"]), more=other))[0].licence == "Own-1.0"


def test_long_licences(spark):
    """Whole texts that this machine carries, where it does."""
    from pathlib import Path

    have = {k: p.read_text(errors="replace") for k, p in (("GPL-3.0", Path("/usr/share/common-licenses/GPL-3")), ("Apache-2.0", Path("/usr/share/common-licenses/Apache-2.0")), ("MPL-2.0", Path("/usr/share/common-licenses/MPL-2.0"))) if p.exists()}
    got = by_id(licenses.scan(docs(spark, list(have.values()))))
    assert [got[i].licence for i in range(len(have))] == list(have)
