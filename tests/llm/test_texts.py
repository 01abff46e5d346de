"""Copies, repeated lines, token ids, mixtures and garbled texts."""

import random
import re
from collections import Counter, defaultdict
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import catalog, dedup, encode, garbled, lines, mix


# ------------------------------------------------------------------------------------------- copies

PAGES = "page_id bigint, url string, canonical string, rep bigint, id bigint, _id string, n string, v string"


def crawl(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "", "", "") for r in rows], PAGES)


def found(df):
    return {(r.rep, r.id) for r in dedup.copies(df, "page_id", ["url", "canonical"]).filter("rep <> id").collect()}


def test_copies_and_look_alikes(spark):
    u = "https://e.example/a/b-c"
    rows = [
        (1, u, None), (2, "HTTPS://E.example//a/b+c/ \t", None), (3, "\xa0https://e.example/a/%62-%63.", None), (4, u, u), (5, u, ""), (6, "http://e.example/a/b-c", None),
        (7, u + "?x=1&y=2", None), (8, u + "/?y=2&&X=1&", None), (9, u + "?x=1&y=3", None), (10, u + "?x=1", None), (11, u + "?x=1&y=2&y=2", None), (12, u + "?x=2&y=1", None), (13, None, None), (14, None, None), (15, u + "%", None), (None, u, None), (None, u, None), (16, u + "?%zz=1", None),
    ]
    df = crawl(spark, rows)
    assert found(df) == {(1, 2), (1, 3), (1, 15), (7, 8), (13, 14)}
    assert found(df.unionByName(df)) == found(df)
    assert found(df.limit(0)) == set()


def test_hot_group_of_copies(spark):
    df = crawl(spark, [(i, "https://e.example/x" + "." * (i % 5) if i % 3 else f"https://e.example/{i}", None) for i in range(900)])
    got = found(df)
    assert len(got) == 599 and {a for a, _ in got} == {1}
    counts = {r.rep: r.n_copies for r in dedup.copy_counts(df, "page_id", ["url", "canonical"]).collect()}
    assert counts[1] == 600 and sum(counts.values()) == 900
    split = {(r.rep, r.id) for r in dedup.copies(df, "page_id", ["url", "canonical"], hot=50).filter("rep <> id").collect()}
    assert split == got
    twice = {r.rep: r.n_copies for r in dedup.copy_counts(df.unionByName(df), "page_id", ["url", "canonical"]).collect()}
    assert twice == counts  # repeated ids count once


def test_collisions_are_told_apart(spark, monkeypatch):
    """Records under one fingerprint whose fields differ are other records."""
    real = dedup.multiset_hash
    monkeypatch.setattr(dedup, "multiset_hash", lambda pairs, seed=0: real(F.slice(pairs, 1, 0), 0) if seed == 0 else real(pairs, seed))
    df = crawl(spark, [(1, "https://e.example/a", None), (2, "https://e.example/b", None), (3, "https://e.example/A", None), (4, "https://e.example/B", None), (5, "https://e.example/c", None)])
    assert found(df) == {(1, 3), (2, 4)}
    assert {r.rep: r.n_copies for r in dedup.copy_counts(df, "page_id", ["url", "canonical"]).collect()} == {1: 2, 2: 2, 5: 1}


def test_equal_pairs_do_not_cancel(spark):
    pair = lambda *xs: F.array(*(F.struct(F.lit(a).alias("n"), F.lit(b).alias("v")) for a, b in xs))
    a, b, c = [("p", "1")], [("p", "1")] * 3, [("p", "1"), ("q", "2")]
    row = spark.range(1).select(dedup.multiset_hash(pair(*a)) == dedup.multiset_hash(pair(*b)), dedup.multiset_hash(pair(*c)) == dedup.multiset_hash(pair(*c[::-1])), dedup.same_multiset(pair(*c), pair(*c[::-1])), dedup.same_multiset(pair(*b), pair(*(a + c)))).first()
    assert list(row) == [False, True, True, False]


def test_copies_equal_brute_force(spark, data):
    def key(u):
        if u is None:
            return None
        head, _, rest = u.partition("?")
        n = lambda s: re.sub(r"[\W_]+", "", unquote(s).lower())
        return n(head), tuple(sorted((n(p.partition("=")[0]), n(p.partition("=")[2])) for p in rest.split("#")[0].split("&") if n(p)))

    df = spark.read.parquet(f"{data}/crawl_pages.parquet")
    groups = defaultdict(list)
    for r in df.select("page_id", "url", "canonical").collect():
        groups[key(r.url), key(r.canonical)].append(r.page_id)
    assert found(df) == {(min(g), x) for g in groups.values() for x in g if x != min(g)}


# ------------------------------------------------------------------------------------------- lines

DOCS = "page_id bigint, host string, raw_html string, chunk bigint, salt int, id bigint, line_no int"


def brute(rows, least):
    pages = defaultdict(set)
    at = defaultdict(list)
    for p, h, t, *_ in rows:
        for i, x in enumerate(lines.line_letters(t or "")):
            if x:
                pages[h, x].add(p)
                at[h, x].append((p, i))
    return {o for k, v in pages.items() if len(v) >= least for o in at[k]}


def test_lines_equal_brute_force(spark):
    rnd = random.Random(3)
    menu = ["<li><a href='/1'>About us 12</a></li>", "Share this page!", "  &copy; Zürich AG, all rights reserved &amp; more", "x" * 300 + " long line", "12 34", ""]
    rows = []
    for p in range(60):
        text = [rnd.choice(menu) if rnd.random() < 0.5 else f"own line {p} {''.join(rnd.choice('abc') for _ in range(9))}" for _ in range(12)]
        rows.append((p, rnd.choice(["a", "a", "a", "b", None]), None if p % 17 == 0 else "\r\n".join(text), 0, 0, 0, 0))
    rows += [(None, "a", "Share this page!", 0, 0, 0, 0)] * 7 + [(100, "a", "", 0, 0, 0, 0), (101, "a", "<script>\nShare this page\n</script>\nShare <b>THIS</b> page", 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, DOCS)
    want = brute([r for r in rows if r[0] is not None], 6)
    assert want and {(r.id, r.line_no) for r in lines.repeated_lines(df, "page_id", "host", "raw_html").collect()} == want
    # with hot lines split off, long lines that share chunks, and rows given twice
    assert {(r.id, r.line_no) for r in lines.repeated_lines(df, "page_id", "host", "raw_html", hot=10).collect()} == want
    assert {(r.id, r.line_no) for r in lines.repeated_lines(df.unionByName(df), "page_id", "host", "raw_html").collect()} == want
    assert lines.repeated_lines(df.limit(0), "page_id", "host", "raw_html").count() == 0


def test_five_pages_and_one_twice_are_too_few(spark):
    df = spark.createDataFrame([(i % 5, "h", "Share this page\nShare this page", 0, 0, 0, 0) for i in range(6)], DOCS)
    assert lines.repeated_lines(df, "page_id", "host", "raw_html").count() == 0


def test_long_lines_of_repeated_chunks_are_counted_as_a_whole(spark):
    rnd = random.Random(8)
    a, b, c = ("".join(rnd.choice("abcdefghij") for _ in range(400)) for _ in range(3))
    rows = [(i, "h", [a + b, a + b + c, c + a][i % 3] + ("\n" + a + b if i < 3 else ""), 0, 0, 0, 0) for i in range(15)]
    want = brute(rows, 6)
    assert want and {(r.id, r.line_no) for r in lines.repeated_lines(spark.createDataFrame(rows, DOCS), "page_id", "host", "raw_html").collect()} == want


def test_chunks_decide(spark):
    """A line of one chunk comes out by the count of its chunk alone."""
    df = spark.createDataFrame([(i, "h", "Share this page\n" + f"own words of page {'abcdefghij'[i]}", 0, 0, 0, 0) for i in range(9)], DOCS)
    chunks = lines.line_chunks(df, "page_id", "host", "raw_html")
    got = lines.repeated_chunks(chunks, 6)
    assert {(r.id, r.line_no) for r in got.collect()} == {(i, 0) for i in range(9)}
    assert lines.repeated_chunks(chunks, 10).count() == 0


def test_chunks_depend_on_content_only():
    rnd = random.Random(5)
    body = "".join(rnd.choice("abcdefghij") for _ in range(3000))
    a, b = lines.chunk_ends(body), lines.chunk_ends("zzz" + body)
    assert len(a) > 10 and {x + 3 for x in a} & set(b) >= {x + 3 for x in a if x > 40}
    assert lines.chunk_ends("abc") == [3]


def test_cut_lines(spark):
    df = spark.createDataFrame([(1, "h", "a\nb\nc", 0, 0, 0, 0), (2, "h", None, 0, 0, 0, 0)], DOCS)
    cut = spark.createDataFrame([(1, 1), (1, 1)], "id bigint, line_no int")
    assert {(r.id, r.text_without) for r in lines.without_lines(df, cut, "page_id", "raw_html").collect()} == {(1, "a\nc"), (2, None)}


def test_each_html_is_left_without_its_repeated_lines(spark, data):
    cuts = {}
    for r in catalog.QUERIES["p7_found"](spark, data).collect():
        cuts.setdefault(r.page_id, set()).add(r.line_no)
    pages = {r.page_id: r.raw_html for r in spark.read.parquet(f"{data}/crawl_pages.parquet").collect()}
    got = {r.page_id: r.raw_html for r in catalog.QUERIES["p7_without"](spark, data).collect()}
    assert cuts and got == {k: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cuts.get(k, ())) for k, t in pages.items()}


# ------------------------------------------------------------------------------------------- token ids


def test_round_trip_of_ids(spark):
    texts = ["", None, "plain text", "日本語 and ünïcode 👩‍🔧 <|endoftext|>", "a" * 200_000, "\r\n\t \xa0", "\u0000x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = encode.encode(df, "doc_id", "text")
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got[0] == got[1] == [] and 50256 not in got[3]
    assert {r.doc_id: r.text for r in encode.decode(ids, "doc_id").collect()} == {i: t or "" for i, t in enumerate(texts)}
    at = encode.encode(df.filter("doc_id = 3"), "doc_id", "text", offsets=True).first()
    assert at.ids == got[3] and at.starts[0] == 0 and at.ends[-1] == len(texts[3])
    assert encode.encode(df.limit(0), "doc_id", "text").count() == 0


def test_ids_equal_the_other_library(spark, data):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as public

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in encode.encode(df, "doc_id", "text").collect()}
    assert got == {r.doc_id: other.encode_ordinary(r.text or "") for r in df.collect()}


# ------------------------------------------------------------------------------------------- mixtures


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        x = np.arange(n)
        p = mix.feistel(x, np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(p) == list(range(n))
    assert (mix.feistel(np.arange(1000), np.full(1000, 1000), np.full(1000, 1, np.uint64)) != mix.feistel(np.arange(1000), np.full(1000, 1000), np.full(1000, 2, np.uint64))).any()


def test_feistel_can_be_inverted():
    for n in (1, 2, 3, 10, 1000, 4097):
        x, size, key = np.arange(n), np.full(n, n), np.full(n, 99, np.uint64)
        assert (mix.feistel(mix.feistel(x, size, key), size, key, inverse=True) == x).all()


def test_slots_meet_shares_and_caps():
    tokens, blocks = {"a": 100_000, "b": 50_000, "c": 600}, {"a": 391, "b": 196, "c": 3}
    targets = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 4), ("none", 0.1, 3)]
    slots = mix.draw_slots(tokens, blocks, targets, None)
    assert slots["c"] <= 12 and slots["a"] / sum(slots.values()) == pytest.approx(0.5 / 0.9, abs=0.03)
    assert mix.draw_slots(tokens, blocks, targets, 10**9) == {"a": 782, "b": 196, "c": 12}
    assert mix.draw_slots({}, {}, targets, None) == {}


def test_shards_are_mixed_and_full(spark):
    """Every cell is taken once, every shard is full, and its counts are near the shares, as a multinomial draw has them."""
    docs = spark.createDataFrame([(i, f"word{i} and more words " * 60, "a" if i % 4 else "b") for i in range(400)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 3)], "source string, target_share double, max_repeats int")
    rows = mix.mixture(docs, t, block=32, shard_blocks=200, bucket_chars=20_000)[0].select("shard", "position", "source", "round", "block_no").collect()
    assert {(r.shard * 200 + r.position) for r in rows} == set(range(len(rows)))
    n = Counter(r.source for r in rows)
    assert all(v == 1 for v in Counter((r.source, r["round"], r.block_no) for r in rows).values())
    for s in range(len(rows) // 200):
        assert sum(r.source == "b" for r in rows if r.shard == s) == pytest.approx(200 * n["b"] / len(rows), abs=35)
    assert len({sum(r.source == "b" for r in rows if r.shard == s) for s in range(len(rows) // 200)}) > 1


def test_mixture(spark):
    text = "the quick brown fox jumps over the lazy dog " * 40
    docs = [(i, text + str(i), ["a", "b", "tiny"][0 if i < 30 else 1 if i < 45 else 2], "x") for i in range(47)] + [(60, None, "a", "x"), (61, "", "b", "x"), (62, text, None, "x"), (63, text, "other", "x"), (3, text + "3", "a", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, ids string")
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("tiny", 0.1, 3), ("closed", 0.05, 2)], "source string, target_share double, max_repeats int")
    m, report = mix.mixture(df, t, block=64)
    rows = m.collect()
    assert {r.source for r in rows} == {"a", "b", "tiny"}
    times = Counter((r.source, r.block_no) for r in rows)
    assert all(v <= {"a": 1, "b": 2, "tiny": 3}[s] for (s, _), v in times.items())
    rep = {r.source: r for r in report.collect()}
    assert rep["closed"].tokens_taken == 0 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    for s, w in (("a", 0.6), ("b", 0.3), ("tiny", 0.1)):
        assert rep[s].actual_share == pytest.approx(w, abs=0.03)
    ids = {r.doc_id: r.ids for r in encode.encode(df, "doc_id", "text").collect()}
    packed = [x for r in sorted({(r.block_no, tuple(r.ids)) for r in mix.token_blocks(df, ["a", "b", "tiny", "closed"], block=64).filter("source = 'tiny'").collect()}) for x in r[1]]
    assert len(packed) == len(ids[45]) + len(ids[46])
    a, b = mix.mixture(df.limit(0), t)
    assert a.count() == 0 and b.count() == 4


# ------------------------------------------------------------------------------------------- garbled texts


def test_garbled_texts(spark):
    clean = {
        "de": "Die Werkstatt prüft die schöne Dämmung für große Gärten. Unser Team ändert die Öffnungszeiten während der Wintermonate.", "fr": "La salle de lecture protège les étiquettes colorées près de là. L’équipe préfère le café français à côté.",
        "ru": "Школьная кухня показывает старый план дренажа. Каждый посетитель собирает сезонные овощи после сильного дождя.", "ja": "二週間ごとに、この自転車は予備の部品を紹介します。多くの場合、太陽光パネルは簡単な一覧表を守っています。",
    }
    docs = [(i, clean[k], k, k) for i, k in enumerate([*clean] * 40)]
    bad = {
        1001: clean["de"].encode().decode("cp1252"), 1002: clean["de"].encode("cp1252").decode("mac_roman"), 1003: clean["fr"].encode("utf-8").decode("latin-1"), 1004: clean["ru"].encode("cp1251").decode("koi8-r"),
        1005: clean["ru"].encode().decode("latin-1"), 1006: clean["ja"].encode("euc_jp").decode("latin-1"), 1007: clean["de"].replace("ü", "�"), 1008: clean["de"] + "\n" + clean["de"].encode().decode("latin-1"),
    }
    fine = {2001: "The sign “Ã¤” in place of ä is a well-known symptom.", 2002: "Write `√ü` into the test page.", 2003: "A reader told us that � stood where ü belongs.", 2004: "MAÇÃ, PÃO, LIMÃO. ÂGE ET PÂTE.", 2005: "", 2006: None, 2007: "שלום ᚠᚢᚦ 한국어 👩‍🔧 ½ cup", 2008: "plain"}
    rows = docs + [(i, t, "de", "s") for i, t in {**bad, **fine, None: bad[1001]}.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.id: r.restored_text for r in garbled.restored(df).collect()}
    assert set(got) == set(bad)
    assert got[1001] == clean["de"] and got[1003] == clean["fr"] and got[1004] == clean["ru"] and got[1006] == clean["ja"]
    assert garbled.restored(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------- catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries(spark, data, name):
    from tests.test_catalog import equal_to_sql

    if name in catalog.SQL:
        equal_to_sql(spark, data, catalog.QUERIES[name], catalog.SQL[name])
    else:
        assert catalog.QUERIES[name](spark, data).count() > 0
