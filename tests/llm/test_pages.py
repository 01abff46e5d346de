"""Blocks, main content, spam, residue and languages of pages."""

import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwright.llm import blocks as B, catalog, clauses as C, density as D, language as L, pages as P, residue as R
from loomwright.llm.components import components

SPLITS = "run_id bigint, url string, markdown string, skeleton string, chunk string, id bigint, label string, component bigint"
RUNS = "run_id bigint, url string, html string, status int, body string, k1 bigint"
EN = "The museum shop describes a warm lining, because the mountain hut needs the old drainage plan. Every visitor checks the opening hours with great care."
PAGE = f"[Home](/) | [Shop](/1)\n\nYou are here: Home > Shop\n\n# A title\n\n{EN}\n\n```\ncode\n\nmore\n```\n\n### Related articles\n\n- [One](/a/x)\n- [Two](/a/y)\n\nWe use cookies to count visits.\r\n\r\n© 2024 Zorro shop. All rights reserved."
SPAM = "# Shoes\n\n" + ", ".join(["cheap running shoes", "buy running shoes", "best running shoes online"] * 20)
ERROR = "# 404 Page not found\n\nSorry, the page you are looking for could not be found.\n\nRequest ID: AB12345"
LINKS = "# Links\n\n" + "\n".join(f"* [site-{i}](https://s{i}.test/?id={i})" for i in range(40))


def frames(spark, texts, html=(), without_id=(SPAM, ERROR, PAGE)):
    s = spark.createDataFrame([(i, "https://www.zorro-shop.example/a", t, None, "c", 1, "l", 2) for i, t in [*enumerate(texts), *((None, t) for t in without_id)]], SPLITS)
    return s, spark.createDataFrame([(i, "https://www.zorro-shop.example/a", h, 200, "b", 1) for i, h in html], RUNS)


def test_blocks_are_runs_of_lines_that_are_not_blank():
    assert [len(x) for x in B.split_blocks("a\nb\r\n\r\n \t\nc\r\rd")] == [2, 1, 1]
    assert B.split_blocks(None) == B.split_blocks("") == B.split_blocks(" \n\t") == []


def test_body_of_a_page(spark):
    s, r = frames(spark, [PAGE, None, "", "  \n"])
    assert sorted((x.run_id, x.block_no) for x in P.body_blocks(s, r).collect()) == [(0, i) for i in (2, 3, 4, 5)]
    assert P.page_blocks(s, r).filter("not body").count() == 6
    assert P.body_blocks(s.limit(0), r).count() == 0


# a page whose furniture is written in words that no list has; the containers tell
ODD = "Visitors of the harbour may send a postcard to the office, and the office answers every postcard in spring."
HTML = "<html><body><div class='x'><p>{odd}</p><ul>{menu}</ul></div><div class='y'><h1>A title</h1><p>{one}</p><h2>Next</h2><p>{two}</p><img src='/p.png'></div><div class='x'><p>Tell a neighbour</p></div><div class='y'><p>{three}</p></div><div class='z'><ul>{menu}</ul></div></body></html>"


def odd_page():
    one, two, three = (" ".join([EN.replace("museum", x)] * 2) for x in ("toy", "book", "tea"))
    menu = "".join(f"<li><a href='https://e.example/{i}'>Room {i} of the house</a></li>" for i in range(9))
    md = "\n\n".join([ODD, "\n".join(f"- [Room {i} of the house](https://e.example/{i})" for i in range(9)), "# A title", one, "## Next", two, "![a picture](/p.png)", "![](/elsewhere.png)", "Tell a neighbour", three, "\n".join(f"- [Room {i} of the house](https://e.example/{i})" for i in range(9))])
    return md, HTML.format(odd=ODD, menu=menu, one=one, two=two, three=three)


def test_density_selects_the_body_where_no_cue_helps(spark):
    md, html = odd_page()
    s, r = frames(spark, [md], [(0, html), (0, html)])
    got = {x.block_no for x in P.body_blocks(s, r).collect()}
    assert {2, 3, 4, 5, 6, 9} <= got and not got & {0, 1, 10}
    # without the html's tree the cues know none of them
    assert {x.block_no for x in P.body_blocks(s, r.limit(0)).collect()} >= {0, 1, 10}
    only, _ = frames(spark, [None], [(0, html)])
    text = P.main_text(only, r).first().body_text
    assert "# A title" in text and "toy shop" in text and "Room 3" not in text and ODD not in text


def test_marks_of_odd_html():
    assert D.html_marks(None) == D.html_marks("") == D.html_marks(" \n") == b""
    assert list(D.read_marks(D.html_marks("just words")).values()) == [D.DENSE]
    assert D.html_marks("<div>" * 50_000 + "deep" + "</p></div>" * 9)
    assert D.html_marks("<p>x" * 3000 + "<a href=>&amp;<b") and D.read_marks(None) == {}


def test_very_long_page_is_processed_whole(spark):
    s, r = frames(spark, ["# T\n\n" + "\n\n".join(f"{EN} {i}." for i in range(4000))], [(0, None)])
    assert P.body_blocks(s, r).count() == 4001
    assert P.keyword_spam(s, r).filter("is_spam").count() == 0


def test_spam_and_residue(spark):
    filler = "# Demo\n\nTBD TODO\n\nYour text goes here."
    mention = f"# How to\n\n{EN} {EN}\n\nThe text “404 Page not found” means {EN}\n\n{EN}\n\nThe gallery explains every ticket because of {{{{ date }}}} and the museum shop."
    texts = [SPAM, LINKS, ERROR, filler, PAGE, mention, None, None, "", "{{company}} Home [[product.name]]\n\n* %ORDER_ID%\n* {DESCRIPTION}"]
    body = "".join(f"<p>{x}</p>" for x in SPAM.split("\n\n"))
    s, r = frames(spark, texts, [(6, f"<html><head><title>x</title></head><body>{body}</body></html>"), (7, "<body><noscript>Please enable JavaScript to continue using this application.</noscript></body>"), (4, body)])
    assert {x.run_id for x in P.keyword_spam(s, r).filter("is_spam").collect()} == {0, 1, 6}
    assert {x.run_id for x in P.residue_pages(s, r).collect()} == {2, 3, 7, 9}
    again = s.unionByName(s)
    assert P.keyword_spam(again, r).count() == P.keyword_spam(s, r).count()
    assert P.residue_pages(again, r.unionByName(r)).count() == 4
    assert P.residue_pages(s.limit(0), r.limit(0)).count() == 0
    assert P.keyword_spam(s.limit(0), r.limit(0)).count() == 0


def test_residue_is_reached_over_shared_sentences(spark):
    """Words that no list has are known by the pages they share with residue that shows by its form; without links they aren't."""
    gone, lost = "Diese Adresse führt nirgendwo hin", "The address you came by leads nowhere any more, and the keeper of this place has been told about it by a pigeon that flew before noon over the hills of the old town"
    texts = [f"# Error 404\n\n{gone}!", f"{gone}.", f"{gone}.\n\n{lost}.", f"{lost} today.", "The pigeon came home.", f"{EN} {EN} {EN}\n\n{gone}."]
    s, r = frames(spark, texts)
    got = {x.run_id: x.trusted for x in P.residue_pages(s, r).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}


def test_without_clauses_only_repeats_make_spam(spark):
    """The automaton decides: as few clauses, but other words each time, is none."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(4))
    varied = "# Names\n\n" + ", ".join(word() for _ in range(120))
    s, r = frames(spark, [SPAM, varied])
    got = {x.run_id: x for x in P.keyword_spam(s, r).collect()}
    assert got[0].is_spam and not got[1].is_spam
    assert got[0].clause_share == got[1].clause_share == 0 and got[0].repeat_share > 0.8 and got[1].repeat_share < 0.1


def test_residue_spreads_to_near_texts(spark):
    base = "The requested resource vanished from this machine and the operators of this place were told about the loss of it so that they look into it soon while you wait for them"
    near = base.replace("soon", "later")
    reps = [(1, base), (2, near), (3, "quite another text with other words in it that shares nothing with the first one at all")]
    rows = []
    for i, t in reps:
        w = t.lower().split()
        sh = P.shingle_hashes(w)
        rows.append((i, P._signed(P.simhash([P.xxhash.xxh3_64_intdigest(x.encode()) for x in w] + list(sh))), sorted(map(P._signed, sh))))
    df = spark.createDataFrame(rows, "rep bigint, simhash bigint, shingles array<bigint>")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and bin((a[1] ^ b[1]) & (1 << 64) - 1).count("1") <= P.HAMMING and len(set(a[2]) & set(b[2])) >= P.SIMILAR * len(set(a[2]) | set(b[2]))}
    assert {(r.a, r.b) for r in P.near_pairs(df).collect()} == want


def test_tables_lose_no_pair_within_three_bits(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(20)]
    hashes = [h for b in base for h in (b, b ^ 1, b ^ (1 << 20 | 1 << 40), b ^ (1 << 3 | 1 << 33 | 1 << 63), b ^ 15)]
    rows = [(i, P._signed(h), [1]) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "rep bigint, simhash bigint, shingles array<bigint>")
    want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if bin(hashes[i] ^ hashes[j]).count("1") <= 3}
    assert {(r.a, r.b) for r in P.near_pairs(df).collect()} == want


def test_similar_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for n in [30, 45, 60, 90, 120, 150] * 6:
        words = [rnd.choice(vocabulary) for _ in range(n)]
        at, k = rnd.randrange(n - 4), rnd.randrange(1, 5)
        texts += [words, words[:at] + [rnd.choice(vocabulary) for _ in range(k)] + words[at + k :], words[: n - 2]]
    sets = [P.shingle_hashes(w) for w in texts]
    rows = [(i, P._signed(P.simhash(list(x))), sorted(map(P._signed, x))) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "rep bigint, simhash bigint, shingles array<bigint>")
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert {(r.a, r.b) for r in P.similar_pairs(df).collect()} == want
    near = {(r.a, r.b) for r in P.near_pairs(df).collect()}
    assert near < want  # SimHash alone loses some
    assert P.similar_pairs(df.limit(0)).count() == 0


def test_repeats_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        words = [rnd.choice("ab cd ef gh".split()) for _ in range(rnd.randrange(0, 30))]
        least = rnd.choice((2, 3))
        cover = set()
        for n in range(1, len(words) + 1):
            at = {}
            for i in range(len(words) - n + 1):
                at.setdefault(tuple(words[i : i + n]), []).append(i)
            for v in at.values():
                if len(v) >= least:
                    cover |= {i + k for i in v for k in range(n)}
        assert C.repeated_chars(" ".join(words), least) == (2 * len(cover), 2 * len(words))


def test_components_equal_a_union_find(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert {(r.node, r.component) for r in components(df, "a", "b").collect()} == {(x, root(x)) for x in parent}
    assert components(df.limit(0), "a", "b").count() == 0


def test_labels():
    for label, lang in (("EN", "en"), ("pt_BR", "pt"), ("deu", "de"), ("Japanese", "ja"), ("es-MX", "es"), (" fr ", "fr"), ("unknown", None), ("", None), (None, None), ("xx", None)):
        assert L.canonical_label(label) == lang


def test_label_expression_equals_function(spark):
    labels = ["EN", "pt_BR", "deu", "Japanese", "es-MX", "unknown", "", None, "русский"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(L.canonical_column(F.col("l"))).collect()] == [L.canonical_label(x) for x in labels]


def test_codewords_are_far_apart():
    c = L.codewords()
    assert c.shape == (7, 15) and all((c[i] != c[j]).sum() == 8 for i in range(7) for j in range(i))


def test_held_out_accuracy(spark, data):
    """Trained on labels of which some are wrong, the model reads built-in sentences of each language."""
    d = spark.read.parquet(f"{data}/page_splits.parquet").join(spark.read.parquet(f"{data}/content_analysis.parquet").groupBy("run_id").agg(F.max("detected_language").alias("label")), "run_id")
    model = L.train_on(d, "run_id", "markdown", "label")
    texts = {
        "en": "Nobody in the village could remember when the bridge had been built.", "de": "Niemand im Dorf konnte sich erinnern, wann die Brücke gebaut worden war.", "es": "Nadie en el pueblo podía recordar cuándo se había construido el puente.",
        "fr": "Personne au village ne se souvenait de la date de construction du pont.", "pt": "Ninguém na aldeia se conseguia lembrar de quando a ponte tinha sido construída.", "ru": "Никто в деревне не помнил, когда был построен этот мост.", "ja": "村の誰も、その橋がいつ建てられたのか覚えていなかった。",
    }
    best, conf, _ = model.decode(model.outputs([L.clean(t) for t in texts.values()]))
    right = sum(L.LANGUAGES[k] == v for k, v in zip(best, texts))
    assert right >= 6 and (np.asarray(conf) > 0.3).all()


def test_held_out_pages(spark):
    """Trained on half of the labelled pages (some labels are wrong), the other half is read as most of its labels say, and as a model of that half reads it."""
    d = spark.read.parquet("/root/testdata/sf0.01/page_splits.parquet").join(spark.read.parquet("/root/testdata/sf0.01/content_analysis.parquet").groupBy("run_id").agg(F.max("detected_language").alias("label")), "run_id").filter("markdown is not null")
    halves = [d.filter(F.pmod(F.xxhash64("run_id"), F.lit(2)) == k) for k in (0, 1)]
    models = [L.train_on(h, "run_id", "markdown", "label") for h in halves]
    texts, labels = [], []
    for r in halves[1].collect():
        blocks = [b.plain for b in B.parse(r.markdown) if L.running(b) and len(b.plain) > 150]
        if blocks and L.canonical_label(r.label):
            texts.append(L.clean(max(blocks, key=len)))
            labels.append(L.canonical_label(r.label))
    a, b = ([L.LANGUAGES[k] for k in m.decode(m.outputs(texts))[0]] for m in models)
    assert len(texts) > 100
    assert sum(x == y for x, y in zip(a, b)) / len(texts) >= 0.98
    assert sum(x == y for x, y in zip(a, labels)) / len(texts) >= 0.8


def test_outputs_do_not_depend_on_the_batch():
    model = L.train(["the house and the garden"] * 3 + ["das haus und der garten"] * 3, ["en"] * 3 + ["de"] * 3)
    texts = ["the house is near", "der garten ist schön", "x", "a longer text with many words in it and the end"]
    whole = model.outputs(texts)
    assert np.allclose(whole, np.concatenate([model.outputs([t]) for t in texts]), atol=1e-4)
    assert np.allclose(whole, L.features(texts) @ model.weights + model.bias, atol=1e-3)


def test_keys_words_and_letters_are_those_of_the_plain_patterns():
    """The fast ways give what the definitions do, for any sign."""
    pick = random.Random(5)
    signs = "aZé߀ßİΣσςﬁ²Ⅷ٣_- '’.,—“”»。、ーカ漢字ё\u0301\u200b\u00a0\u3000\x1c\x00\t\n\ud800😀09[](/)"
    texts = ["", " ", "ΑΣ ΟΔΟΣ.", "[a b](/c) d_e", *("".join(pick.choices(signs, k=pick.randint(1, 40))) for _ in range(3000)), *("".join(pick.choices("ab '-1._\x1c", k=12)) for _ in range(500))]
    for t in texts:
        key = re.sub(r"[\W_]+", "", t.lower())
        assert D.text_key(t) == (D._signed(xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))) or 4 if key else 0)
        assert L.clean(t) == " ".join(re.sub(r"[^\w\s]|[\d_]", " ", B.LINK.sub(" ", t)).lower().split())
        cjk = re.findall(r"[぀-ヿ㐀-鿿]", t)
        assert L.words_of(t) == len(cjk) / 2 + len(B.WORD.findall(re.sub(r"[぀-ヿ㐀-鿿]", " ", t)))
        assert B.cjk_chars(t) == len(cjk)


def test_counts_of_texts_need_the_room_of_few():
    """Outputs of many texts are computed in the room of SOME rows, and each row is the counts of its text's n-grams."""
    texts = [f"{x} the garden and the house" * (k % 9) for k, x in enumerate(["", "größe", "家", "дом"] * 64)]
    model = L.train(["the house and the garden"] * 3 + ["das haus und der garten"] * 3, ["en"] * 3 + ["de"] * 3)
    tracemalloc.start()
    model.outputs(texts[:100])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 64 * L.BUCKETS * 4
    x, norms = L.counts(texts)
    for t, row, norm in zip(texts, x, norms):
        once = np.bincount(L.grams([t])[0].ravel(), minlength=L.BUCKETS)
        assert (row == once).all() and np.isclose(norm[0], max(np.linalg.norm(once), 1e-9))


def test_furniture_is_looked_for_only_where_it_decides(monkeypatch):
    """Blocks that the html's tree has decided on aren't searched for cues, and the bodies are those of the whole check."""
    many = [f"{EN} Number {i} of the list is kept in the reading room." for i in range(30)]
    html = f"<html><body><div class='y'><h1>A title</h1>{''.join(f'<p>{x}</p>' for x in many)}</div><div class='x'><p>Tell a neighbour</p></div></body></html>"
    md = "\n\n".join(["# A title", *many, "Tell a neighbour", "We use cookies to count visits."])
    searched, has, checked = [], B._has, B.checked
    monkeypatch.setattr(B, "_has", lambda low, cues: searched.append(low) or has(low, cues))
    assert [b.no for b in B.body_blocks(md, None, D.html_marks(html))] == list(range(31))
    assert set(searched) == {"we use cookies to count visits."}
    pages = [(md, html), (PAGE, html), (PAGE, None), *((PAGE.replace(EN, x), HTML.format(odd=ODD, menu="<li>a</li>", one=x, two=EN, three=ODD)) for x in many)]
    pages += [(f"## Related articles\n\n- [One](/a/x)\n\n{md}\n\n## Most read this week\n\n{many[3]}\n\nOne\nTwo", html)]
    some = [[b.no for b in B.body_blocks(m, "https://www.zorro-shop.example/a", D.html_marks(h))] for m, h in pages]
    monkeypatch.setattr(B, "checked", lambda blocks, url=None, asked=None: checked(blocks, url))
    assert some == [[b.no for b in B.body_blocks(m, "https://www.zorro-shop.example/a", D.html_marks(h))] for m, h in pages]


@pytest.fixture(scope="module")
def labelled(spark):
    es = "El taller apoya una garantía más larga para toda la familia cerca del pueblo. Con mucho cuidado, nuestro equipo describe las verduras de temporada según lo que sabemos."
    page = f"# T\n\n{EN}\n\n{EN}\n\n{es}"
    s, h = frames(spark, [page, f"# T\n\n{es}\n\n{es}", SPAM, None, ERROR, f"# T\n\n{EN}\n\n{EN}", *[f"# T\n\n{x} {i}.\n\n{x}" for i in range(4) for x in (EN, es)]])
    a = spark.createDataFrame([(0, "eng", 1, 1), (0, "eng", 1, 1), (1, "EN", 1, 1), (2, None, 1, 1), (5, None, 1, 1), *[(6 + i, "es-ES" if i % 2 else "English", 1, 1) for i in range(8)]], "run_id bigint, detected_language string, analysed_at bigint, loaded_at bigint")
    return s, h, a


def test_wrong_labels_and_other_blocks(labelled):
    s, h, a = labelled
    got = {(r.run_id, r.block_no, r.lang) for r in L.wrong_languages(s, h, a).collect()}
    assert got == {(0, 3, "es"), (1, -1, "es"), (5, -1, "en")}
    assert {(r.run_id, r.block_no, r.lang) for r in L.wrong_languages(s.unionByName(s), h, a).collect()} == got
    assert L.wrong_languages(s.limit(0), h, a.limit(0)).count() == 0


def test_short_pages_and_blocks_without_a_sentence_are_judged_but_no_residue(spark):
    short = "Nuestro vecino repara esta semana el reloj viejo del pueblo."  # under 120 characters
    es = "El taller apoya una garantía más larga para toda la familia cerca del pueblo, con mucho cuidado y sin prisa"  # no end
    mixed = f"# T\n\n{EN}\n\n{EN}\n\n{es}\n\n" + "Hoy llueve mucho. Nadie sale fuera. El perro ladra. La puerta queda cerrada."  # no sentence of five words
    shown = "Sorry, the page you are looking for could not be found. You may have followed a broken link from another site, or it was taken down by the owner of that site."
    full = [f"# T\n\n{x} {i}.\n\n{x}" for i in range(4) for x in (EN, es + ".")]
    s, h = frames(spark, [f"# T\n\n{short}", mixed, f"# 404 Page not found\n\n{shown}", f"# Nothing here\n\n{shown}", "Only five words.", *full])
    assert C.clause_chars(B.parse(shown))[0] >= 120
    a = spark.createDataFrame([(1, "en", 1, 1), *[(5 + i, "es" if i % 2 else "en", 1, 1) for i in range(8)]], "run_id bigint, detected_language string, analysed_at bigint, loaded_at bigint")
    # the third page shows an error's code, the fourth has its sentences: both are residue, whatever the length
    assert {x.run_id for x in P.residue_pages(s, h).collect()} == {2, 3}
    assert {r.run_id: r.lang for r in L.document_languages(L.page_segments(s, h, a), "run_id").collect()} == {0: "es", 1: "en", **{5 + i: "es" if i % 2 else "en" for i in range(8)}}
    assert {(r.run_id, r.block_no, r.lang) for r in L.wrong_languages(s, h, a).collect()} == {(0, -1, "es"), (1, 3, "es"), (1, 4, "es")}


def test_every_labelled_block_takes_part_in_the_training(spark, monkeypatch):
    start = L.train([], [])  # the built-in words alone
    rows = [(f"der {x} und die {x} sind nicht mit dem {x} {i % 7}", "de") for i, x in enumerate(["qyxvo wyqqa", "xoqwy qaxxu"] * 3000)] + [(f"the {x} and the {x} of that {x} are with them", "en") for x in ["river", "winter"] * 3000]
    texts = spark.createDataFrame([*rows, ("ohne label", None)], "text string, label string").repartition(3)
    model = L.train_further(texts, start, {"de": 6000, "en": 6000})
    new = ["qyxvo wyqqa", "xoqwy qaxxu"]
    (was, _, doubt), (got, conf, _) = start.decode(start.outputs(new)), model.decode(model.outputs(new))
    assert [L.LANGUAGES[k] for k in got] == ["de", "de"] and (conf > 0.8).all() and (([L.LANGUAGES[k] != "de" for k in was]) | doubt).any()
    # without a labelled text the first model stays
    assert np.array_equal(L.train_further(texts.filter("label is null"), start, {}).weights, start.weights)
    # a page's texts beyond the first model's rows reach the training
    s, h = frames(spark, [f"# T\n\n{EN}\n\n{EN}"] * 9)
    a = spark.createDataFrame([(i, "en", 1, 1) for i in range(9)], "run_id bigint, detected_language string, analysed_at bigint, loaded_at bigint")
    seen = []
    monkeypatch.setattr(L, "train_further", lambda texts, first, pages: (seen.append((texts.filter("label is not null").count(), pages)), first)[1])
    L.page_segments(s, h, a, sample=2)
    assert seen == [(18, {"en": 9})]


def test_each_page_and_block_has_a_language(labelled):
    s, h, a = labelled
    seg = L.page_segments(s, h, a)
    blocks = {(r.run_id, r.block_no): r for r in seg.collect()}
    assert all(0 < r.confidence <= 1 for r in blocks.values())
    assert (blocks[0, 1].lang, blocks[0, 3].lang) == ("en", "es")
    pages = {r.run_id: r for r in L.document_languages(seg, "run_id").collect()}
    # pages with a right label too; none of spam, residue or without a text
    assert {k: r.lang for k, r in pages.items()} == {0: "en", 1: "es", 5: "en", **{6 + i: "es" if i % 2 else "en" for i in range(8)}}
    assert pages[0].mixed and not pages[1].mixed and pages[0].confidence < pages[1].confidence <= 1


def test_language_queries(spark, data):
    pages = {r.run_id: r.lang for r in catalog.QUERIES["p5_languages"](spark, data).collect()}
    seg = {(r.run_id, r.block_no): r.lang for r in catalog.QUERIES["p5_segments"](spark, data).collect()}
    assert pages and {k for k, _ in seg} == set(pages)
    for r in catalog.QUERIES["p5_found"](spark, data).collect():
        assert r.lang == pages[r.run_id] if r.block_no < 0 else r.lang == seg[r.run_id, r.block_no] != pages[r.run_id]


def test_each_page_has_its_main_text_and_remains_or_not(spark, data, tmp_path):
    runs, splits = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("page_runs", "page_splits"))
    splits = splits.withColumn("markdown", F.expr("CASE WHEN run_id % 5 <> 0 THEN markdown END"))  # some pages with html only
    runs.write.parquet(f"{tmp_path}/page_runs.parquet")
    splits.write.parquet(f"{tmp_path}/page_splits.parquet")
    data = str(tmp_path)
    texts = {r.run_id: r.body_text for r in catalog.QUERIES["p6_main_text"](spark, data).collect()}
    marks = {r.run_id: D.html_marks(r.html) for r in runs.collect()}
    md = {r.run_id: r for r in splits.filter("markdown is not null").collect()}
    only = {r.run_id for r in runs.filter("html is not null").collect()} - set(md)
    assert only and set(texts) == set(md) | only and all(texts[k] for k in only)
    for k, r in md.items():
        assert texts[k] == "\n\n".join(b.text for b in B.body_blocks(r.markdown, r.url, marks[k]))
    found, rest = ({r.run_id for r in catalog.QUERIES[q](spark, data).collect()} for q in ("p4_found", "p4_remaining"))
    assert not found & rest and found | rest == {r.run_id for r in runs.collect()}
